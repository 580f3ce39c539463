"""Near-duplicate documents: MinHash bands for candidates, odd sketches to weed them, full sets to confirm.

1. Each text becomes its set of distinct k-word shingles (64-bit hashes), MinHash values of it, and an
   odd sketch: the MinHash samples folded into a parity bitmap. XOR of two bitmaps counts, by its
   bits, the samples in which two sets differ, which is precise at high similarity.
2. Texts with equal sets are one class. Only one text of a class goes on.
3. ``rows`` MinHash values make a band. The number of bands is chosen so that a pair at the threshold
   shares none with probability ``MISS`` (1e-7) at most.
4. In each band's bucket every class is compared with the bucket's first class (by doc_id) only, never
   all with all. Pairs are weeded by set size and odd sketch (six standard deviations below the
   threshold) and confirmed by exact Jaccard of full sets, recomputed from the texts.
5. All classes that met one first class form its company. Where the confirmed links leave a company in
   more than one component, all but its largest component are compared exactly with the whole
   company, in blocks of bounded size, by a product of incidence matrices; a block returns no more
   links than join its components. So no link between components is lost, no pair is emitted that is
   not a link, and a company that is one component costs nothing.
6. Connected components give every row the smallest doc_id reachable.

Edge cases: null or blank texts have no set and link with nothing; a text shorter than k words is one
shingle; null doc_ids are ignored when the smallest is taken (a component of null ids alone has null and
keeps nothing but is still listed); rows repeated with one doc_id are one class and are all marked
kept or not; other columns are not read. ``drop_near_duplicates`` does not go by that mark but keeps one row
of each component, also where ids are null or repeated.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import free_names, materialise, shingle_set, travels, worker_cache
from siftline.llm.components import components

travels(__name__)

ROWS = 4
MISS = 1e-7
SKETCH_LONGS = 8
SHINGLES_AT_ONCE = 1 << 14
SETS_KEPT = 64
SLAB = 2048
BLOCK_ROWS = 512
BLOCK_SHINGLES = 400_000


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def minhashes(values: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` MinHash values of a set of 64-bit hashes."""
    rng = np.random.default_rng(seed)
    times = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, count, np.uint64)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), SHINGLES_AT_ONCE):
        part = values[at : at + SHINGLES_AT_ONCE]
        part = part ^ (part >> np.uint64(31))
        least = np.minimum(least, (part[None, :] * times[:, None] + plus[:, None]).min(1))
    return least


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, samples at different places being different."""
    place = np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = (_mixed(samples ^ place) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_LONGS)
    odd = np.bincount(bit, minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    bands = samples.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        key = _mixed(key ^ bands[:, i])
    return key.view(np.int64)


def _sketcher(words: int, bands: int, rows: int, seed: int):
    @F.pandas_udf("n_shingles long, node binary, bands array<long>, odd array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            values = shingle_set(t, words)
            if not len(values):
                out.append((0, None, None, None))
                continue
            samples = minhashes(values, bands * rows, seed)
            node = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
            out.append((len(values), node, band_keys(samples, rows), odd_sketch(samples)))
        return pd.DataFrame(out, columns=["n_shingles", "node", "bands", "odd"])

    return sketched


def _verifier(words: int, hundredths: int):
    def kept_set(cache: dict, node: bytes, text: str) -> np.ndarray:
        if node not in cache:
            if len(cache) >= SETS_KEPT:
                cache.pop(next(iter(cache)))
            cache[node] = shingle_set(text, words)
        return cache[node]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache(f"shingle_sets_{words}")
        for batch in batches:
            hit = []
            for a, b, left, right in batch[["a", "b", "a_text", "b_text"]].itertuples(index=False):
                x, y = kept_set(cache, a, left), shingle_set(right, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= hundredths * (len(x) + len(y) - both))
            yield batch.loc[hit, ["a", "b"]]

    return verify


def _incidence_product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets on the left with those on the right."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        at = np.searchsorted(shared, values)
        known = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == values) if len(shared) else np.zeros(len(values), bool)
        return row[known], at[known]

    (li, lj), (ri, rj) = places(left), places(right)
    for begin in range(0, len(shared), SLAB):
        slabs = []
        for n, i, j in ((len(left), li, lj), (len(right), ri, rj)):
            inside = (j >= begin) & (j < begin + SLAB)
            slab = np.zeros((n, SLAB), np.float32)
            slab[i[inside], j[inside] - begin] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    return out


def _block_links(words: int, hundredths: int):
    """Links across components between the two sides of a block, as few as connect what is linked."""

    def find(block: pd.DataFrame) -> pd.DataFrame:
        minor, whole = block[block["minor"]], block[~block["minor"]]
        out, joined = [], {}

        def root(x: bytes) -> bytes:
            while x in joined:
                x = joined[x]
            return x

        if len(minor) and len(whole):
            left, right = ([shingle_set(t, words) for t in side["text"]] for side in (minor, whole))
            both = _incidence_product(left, right)
            sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
            code = {r: i for i, r in enumerate(set(block["root"]))}
            apart = minor["root"].map(code).to_numpy()[:, None] != whole["root"].map(code).to_numpy()[None, :]
            a, b, ra, rb = (side[c].tolist() for c in ("node", "root") for side in (minor, whole))
            for i, j in zip(*(apart & (100 * both >= hundredths * (sizes - both))).nonzero()):
                x, y = root(ra[i]), root(rb[j])
                if x != y:
                    joined[x] = y
                    out.append((a[i], b[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return find


def _alike(pairs: DataFrame, classes: DataFrame, hundredths: int, samples: int) -> DataFrame:
    """Pairs whose sizes and odd sketches allow the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(
            classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("odd").alias(f"odd_{side}")), side
        )
    bits, t = 64 * SKETCH_LONGS, hundredths / 100
    least = t - 6 * math.sqrt(t * (1 - t) / samples)
    apart = F.aggregate(
        F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    # Odd bits to expect where 2 * samples * (1 - least) values differ, and what collisions may add.
    most = bits / 2 * (1 - math.exp(-4 * samples * (1 - least) / bits))
    most += 2 * math.sqrt(most)
    return pairs.where(
        (100 * F.least("n_a", "n_b") >= hundredths * F.greatest("n_a", "n_b")) & (apart <= F.lit(min(most, bits)))
    ).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, hundredths: int) -> DataFrame:
    """Pairs of classes whose full shingle sets reach the threshold."""
    for side in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")), side)
    return pairs.select("a", "b", "a_text", "b_text").mapInPandas(_verifier(words, hundredths), "a binary, b binary")


def near_duplicates(
    docs: DataFrame, words: int = 5, hundredths: int = 80, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS, seed: int = 1,
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (doc_id is the smallest of its component).

    Documents are linked if 100 * intersection >= ``hundredths`` * union of their sets of shingles of
    ``words`` words.
    """
    bands = band_count(hundredths / 100, rows)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketched = _sketcher(words, bands, rows, seed)("text")
    table = materialise(
        source.select("doc_id", F.md5("text").alias("text_md5"), sketched.alias("s")).select("doc_id", "text_md5", "s.*"), "sketches"
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5", "n_shingles", "bands", "odd"))
    classes = table.where("node IS NOT NULL").groupBy("node").agg(first.alias("f")).select("node", "f.*")
    classes = materialise(classes.select("node", "doc_id", "text_md5", "n_shingles", "bands", "odd"), "classes")

    band = classes.select("node", "doc_id", F.explode("bands").alias("key"))
    earliest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"]
    leaders = band.groupBy("key").agg(earliest.alias("leader"), F.count("*").alias("size")).where("size > 1")
    met = band.select("node", "key").join(leaders.select("key", "leader"), "key").where("node <> leader")
    met = materialise(met.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "company")

    def with_texts(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("text_md5").alias("m"))
        named = source.withColumn("m", F.md5("text")).join(wanted, ["m"]).where(F.col("doc_id").eqNullSafe(F.col("id")))
        return materialise(named.groupBy("node").agg(F.first("text").alias("text")), "texts")

    star = materialise(_alike(met, classes, hundredths, bands * rows), "candidates")
    texts = with_texts(star.select(F.explode(F.array("a", "b")).alias("node")))
    links = materialise(_confirmed(star, texts, words, hundredths), "links")
    roots = components(links, "a", "b")

    placed = met.join(roots.withColumnRenamed("node", "b"), "b", "left").select("a", F.col("b").alias("node"), F.coalesce("root", "b").alias("root"))
    mixed = placed.groupBy("a").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("a")
    placed = placed.join(mixed, "a", "left_semi").join(classes.select("node", F.col("n_shingles").alias("n")), "node")
    placed = materialise(placed, "mixed")
    if not placed.isEmpty():
        links = links.unionByName(_across(placed, with_texts(placed.select("node")), words, hundredths))
        roots = components(links, "a", "b")

    rooted = classes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    whole = table.select("doc_id", "n_shingles", "node")
    placed = whole.where("node IS NOT NULL").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = whole.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _across(placed: DataFrame, texts: DataFrame, words: int, hundredths: int) -> DataFrame:
    """Links between the components of each company ``a``, from rows (a, node, root, n)."""
    size = (F.count("*").alias("c"), F.sum("n").alias("n"))
    per = placed.groupBy("a", "root").agg(*size)
    whole = per.groupBy("a").agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "n", "root")).alias("most"))

    def blocks(c, n):
        return F.ceil(F.greatest(c / F.lit(float(BLOCK_ROWS)), n / F.lit(float(BLOCK_SHINGLES)), F.lit(1.0))).cast("int")

    plan = whole.select(
        "a", F.col("most.root").alias("main"), blocks(F.col("c"), F.col("n")).alias("wide"),
        blocks(F.col("c") - F.col("most.c"), F.col("n") - F.col("most.n")).alias("high"),
    )
    rows = placed.join(plan, "a")
    own_high, own_wide = (F.pmod(F.xxhash64("node", F.lit(k)), F.col(k)).cast("int") for k in ("high", "wide"))
    minor = rows.where("root <> main").select(
        "a", "node", "root", F.lit(True).alias("minor"), own_high.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j")
    )
    every = rows.select(
        "a", "node", "root", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), own_wide.alias("j")
    )
    block = minor.unionByName(every).join(texts, "node").select("a", "i", "j", "node", "root", "minor", "text")
    found = block.groupBy("a", "i", "j").applyInPandas(_block_links(words, hundredths), "a binary, b binary")
    return materialise(found, "links")


def drop_near_duplicates(docs: DataFrame, words: int = 5, hundredths: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are kept, one row of each group, whatever their ids; same columns.

    The row kept is the first by (doc_id, nulls last; hash of the text). Rows equal in both are told apart
    by their number, which is given once, when the rows are written.
    """
    row, group = free_names(docs, "_row", "_group")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, words, hundredths, row, text).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    first = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text), F.col(row).alias("row")))
    kept = numbered.select(row, doc_id, text).join(groups, row).groupBy(group).agg(first["row"].alias(row)).select(row)
    return numbered.join(kept, row, "left_semi").drop(row)
