"""Near duplicates of the pipeline: SimHash as in operator 2, MinHash bands for pairs beyond it, then the sets compared.

The stage's near duplicates have 0.8 or more of their five-word shingles in common. Documents with one set of shingles
are one class. Classes are linked by operator 2's method first: a fingerprint of their shingles, pigeonhole blocks, a
join on them, and the Hamming distance of two bits. Each such link is then verified by the exact similarity.

At 0.8 64-bit fingerprints differ in ten bits on average (an angle of 27 degrees), so the blocks of a pigeonhole search
for all pairs would have four bits and put every text next to a sixteenth of all others. What fingerprints can't tell
comes from bands of minima besides: of each class BANDS keys of ROWS minima are exchanged; a pair of
similarity 0.8 shares no key with a chance of (1 - 0.8^4)^24, 3 in a million. Classes that share a key are first
compared with the least of them alone, so that n near copies of one text cost n comparisons, spread over tasks. The
links make components. Only where a key's classes are in several components then, those of different components are
compared with each other, by blocks of BLOCK classes: a task holds two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import simhash
from leafmill.llm.common import U64, Flat, byte_texts, give_back, mix, shared_folder, slices, window_hashes, word_hashes
from leafmill.llm.tables import components, kept_rows, saved, text_key

SHINGLE = 5
#: Similarity of at least SIMILAR[0] / SIMILAR[1].
SIMILAR = (4, 5)
BANDS, ROWS = 24, 4
BLOCK = 1024
BASE = U64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, A-Z lower-cased; a text of fewer words has one, without words 0."""
    flat = Flat([x.lower() for x in texts])
    words = word_hashes(flat.words)[0]
    full = window_hashes(words, np.arange(max(len(words) - shingle + 1, 0)), shingle, 57)
    out = []
    for a, b in zip(flat.first[:-1].tolist(), flat.first[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(full[a : b - shingle + 1]))
        else:
            out.append(window_hashes(words, np.array([a]), b - a, 57) if b > a else np.zeros(1, U64))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS)."""
    every = np.concatenate(sets)
    first = np.cumsum([0] + [len(x) for x in sets[:-1]])
    draw = np.random.default_rng(5).integers(1, 1 << 63, (BANDS, ROWS, 2), dtype=np.uint64)
    out = np.zeros((len(sets), BANDS), U64)
    with np.errstate(over="ignore"):
        for i in range(BANDS):
            out[:, i] = U64(i + 1)
            for flip, factor in draw[i]:
                out[:, i] = mix(out[:, i] * BASE + np.minimum.reduceat((every ^ flip) * (factor | U64(1)), first))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    least, most = sorted((len(a), len(b)))
    if SIMILAR[1] * least < SIMILAR[0] * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (least + most - both)


def _class_of(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], U64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(byte_texts(batch["text"]))
        prints = pa.array(np.array([simhash.majority(x.view(np.uint8).reshape(-1, 8)) for x in sets], U64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], _class_of(sets), prints, pa.array(band_keys(sets).view(np.int64).tolist(), pa.list_(pa.int64()))], names=["doc_id", "text_key", "of", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets(byte_texts(batch["text"]))
        yield pa.RecordBatch.from_arrays([_class_of(sets), pa.array([x.tobytes() for x in sets], pa.binary())], names=["of", "shingles"])


def _set(x: pa.BinaryScalar) -> np.ndarray:
    """Where it is, in the batch."""
    return np.frombuffer(x.as_buffer(), U64)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [similar(_set(x), _set(y)) for x, y in zip(batch["mine"], batch["theirs"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))
    give_back()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges within sorted groups, between classes of different parts; a part is a component and what has joined it."""
    now, parts = None, {}
    for batch in batches:
        a, b = [], []
        for group, root, of, data in zip(*(batch[x].to_pylist() for x in ("grp", "root", "of")), batch["shingles"], strict=True):
            if group != now:
                now, parts = group, {}
            mine = _set(data).copy()
            own = next((k for k, part in parts.items() if root in part[0]), root)
            roots, members = parts.pop(own, ({root}, []))
            for k in list(parts):
                hit = next((x for x, other in parts[k][1] if similar(mine, other)), None)
                if hit is not None:
                    a.append(of)
                    b.append(hit)
                    more = parts.pop(k)
                    roots, members = roots | more[0], members + more[1]
            parts[own] = (roots, [*members, (of, mine)])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def fingerprint_pairs(classes: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Pairs (a, b) of classes that operator 2's links connect: those of one fingerprint with the least of them, and the
    least ones of fingerprints within its distance."""
    heads = saved(classes.groupBy("fp").agg(F.min("of").alias("head")), spark, f"{folder}/heads")
    same = classes.join(heads, "fp").filter("of <> head").select(F.col("of").alias("a"), F.col("head").alias("b"))
    of = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"of_{x}"))
    near = simhash.links(heads.select("fp"), spark, f"{folder}/simhash").join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return saved(same.unionByName(near), spark, f"{folder}/fingerprint_pairs")


def similar_links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
    """Edges (a, b) that connect all similar classes. classes: of, fp, bands; sets gives of, shingles of the classes that it
    is called with."""
    by_prints = fingerprint_pairs(classes, spark, folder)
    keys = saved(classes.select("of", F.explode("bands").alias("key")), spark, f"{folder}/keys")
    least = keys.groupBy("key").agg(F.min("of").alias("b"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(of))").alias("who")).filter("n > 1")
    shared = saved(keys.join(least, "key"), spark, f"{folder}/shared")
    wanted = shared.select("of").unionByName(by_prints.select(F.explode(F.array("a", "b")).alias("of")))
    found = saved(sets(wanted.distinct()), spark, f"{folder}/sets")
    pairs = by_prints.unionByName(shared.filter("of <> b").select(F.col("of").alias("a"), "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mine, theirs = found.select(F.col("of").alias("a"), F.col("shingles").alias("mine")), found.select(F.col("of").alias("b"), F.col("shingles").alias("theirs"))
    stars = saved(pairs.join(mine, "a").join(theirs, "b").mapInArrow(_verified, "a long, b long"), spark, f"{folder}/stars")
    roots = components(stars, spark, f"{folder}/first")
    # keys with the same classes are looked at once; those of two classes have been compared
    once = shared.filter("n > 2").groupBy("n", "who", "b").agg(F.min("key").alias("key")).select("key")
    rooted = shared.join(once, "key", "left_semi").join(roots, F.col("of") == roots.node, "left").select("key", "of", "n", F.coalesce("root", "of").alias("root"))
    rooted = saved(rooted, spark, f"{folder}/rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine_of = F.pmod(F.xxhash64("of"), blocks).cast("int")
    apart = rooted.join(several, "key", "left_semi").withColumn("blocks", blocks).withColumn("mine", mine_of).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = apart.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "root", "of")
    rest = dealt.join(found, "of").repartition("grp").sortWithinPartitions("grp", "root", "of").select("grp", "root", "of", "shingles").mapInArrow(_across, "a long, b long")
    return saved(stars.unionByName(rest).distinct(), spark, f"{folder}/links")


def keep_first_similar(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """One row of docs for each group of near duplicates, with all columns as they are: that with the smallest doc_id.

    Near duplicates are linked by a similarity of 0.8 or more of their five-word shingles, and by links of links; null,
    empty and blank texts have one shingle, so they are near duplicates of each other. Of repeated rows one stays; of
    rows with one doc_id and other texts each is judged by its own text. Rows without a doc_id can't be told apart and
    stay. Empty tables give no rows; other columns may have any type and name.
    """
    folder = shared_folder(spark, "shingles")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    signed = saved(texts.mapInArrow(_signatures, "doc_id long, text_key long, of long, fp long, bands array<long>"), spark, f"{folder}/signatures")
    classes = signed.groupBy("of").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))

    def sets(wanted: DataFrame) -> DataFrame:
        one = classes.join(wanted, "of", "left_semi").select("least.*")
        return texts.join(one, ["doc_id", "text_key"], "left_semi").select("text").mapInArrow(_sets, "of long, shingles binary").dropDuplicates(["of"])

    roots = components(similar_links(classes, sets, spark, folder), spark, folder)
    rooted = classes.join(roots, classes.of == roots.node, "left").select(F.coalesce("root", "of").alias("root"), "least")
    return kept_rows(docs, rooted.groupBy("root").agg(F.min("least").alias("x")).select("x.*"))
