"""Match posts to catalogs and registries by text or by vector."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.functions import vocab as V
from siftline.operators import setjoin as J
from siftline.operators.ann import approx_join
from siftline.operators.knn import knn_join
from siftline.operators.ranking import first_per_group
from siftline.session import cut, discard, kept

STEP = 0.1  # what a shared key term adds
CONTAINED = 0.2  # what one text containing the other adds
ROUND_CHARS = 1 << 26  # that pairs carry in one round at least
MIN_LEVEL = 1e-6  # below any similarity of texts that share a token


# -- column functions -------------------------------------------------------


def cosine(a: X.Col, b: X.Col) -> Column:
    """Cosine in double precision; 0 for a NULL or zero vector."""
    a, b = (F.transform(X.as_col(v), lambda x: x.cast("double")) for v in (a, b))

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def cosine_from_l2(squared_distance: X.Col) -> Column:
    """Cosine of unit vectors from their squared distance."""
    return 1 - X.as_col(squared_distance) / 2


def text_similarity(a: X.Col, b: X.Col, boost: bool = True, both_empty: float = 1.0) -> Column:
    """Jaccard of whitespace tokens; with ``boost`` equality counts 1 and containment 0.2 more."""
    sim = J.jaccard(X.token_set(a), X.token_set(b), both_empty)
    return _boosted(sim, F.lower(X.as_col(a)), F.lower(X.as_col(b)), F.size(X.tokens(a)), F.size(X.tokens(b))) if boost else sim


def _boosted(sim: Column, la: Column, lb: Column, na: Column, nb: Column) -> Column:
    """Equal texts have equal tokens, hence 1; of two texts the longer one may contain the other."""
    within = F.when(F.length(la) >= F.length(lb), la.contains(lb)).otherwise(lb.contains(la))
    return F.when((na == 0) | (nb == 0) | (sim >= 1), sim).when(within, F.least(sim + CONTAINED, F.lit(1.0))).otherwise(sim)


def term_mask(text: X.Col, terms: Sequence[str]) -> Column:
    """One bit per key term found in the (lower-case) text."""
    mask = F.lit(0)
    for i, term in enumerate(terms):
        mask = mask + F.when(X.as_col(text).contains(term), 1 << i).otherwise(0)
    return mask


def _boost_terms(jac: Column, shared: Column, terms: Sequence[str]) -> Column:
    sim = jac
    for i in range(len(terms)):
        sim = sim + F.when(shared.bitwiseAND(F.lit(1 << i)) > 0, STEP).otherwise(0.0)
    return F.least(sim, F.lit(1.0))


# -- registry lookup --------------------------------------------------------


def _distinct_texts(df: DataFrame, ident: str, text: str, both_empty: float) -> tuple[DataFrame, DataFrame]:
    """(id, k) and one row per distinct lower-case text: (k, first, low, toks, ntok).

    The texts are written out once; their tokens, which take several times their room, are made anew where they are used.
    """
    low = df.select(F.col(ident).alias("id"), F.lower(X.blank(text)).alias("low")).withColumn("k", F.md5("low"))
    members = low.select("id", "k")
    texts = kept(low.groupBy("k").agg(F.min("id").alias("first"), F.min("low").alias("low")), "distinct-texts")
    return members, with_tokens(texts, both_empty)


def with_tokens(texts: DataFrame, both_empty: float) -> DataFrame:
    """Add ``toks``, the distinct tokens of ``low``, and their number ``ntok``."""
    sets = texts.withColumn("toks", F.array_distinct(X.tokens("low"))).withColumn("ntok", F.size("toks"))
    if both_empty > 0:  # texts without tokens match each other: give them one common token
        return sets.withColumn("toks", F.when(F.col("ntok") == 0, F.array(F.lit(""))).otherwise(F.col("toks")))
    return sets.where("ntok > 0")


def jaccard_floor(threshold: float, boost: bool) -> float:
    """The Jaccard similarity that a pair at the threshold has at least."""
    return max(threshold - (CONTAINED if boost else 0.0), 1e-6)


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, boost: bool = True, earlier: bool = False) -> DataFrame:
    """(lk, rk, similarity) of all pairs of distinct texts at or above the threshold.

    With ``earlier`` only pairs whose left text came first. Sets are joined at the threshold itself; pairs
    that reach it by containment alone are found as such (``setjoin.within``), not by a join at a lower one.
    """
    def light(sets: DataFrame) -> DataFrame:
        # Hashes for keys and tokens: what shares one is told apart when pairs are scored.
        hashed = F.transform("toks", lambda t: F.xxhash64(t)).alias("toks")
        return kept(sets.select(F.xxhash64("k").alias("k"), hashed, "first", F.length("low").alias("chars")), "hashed-texts")

    l = light(left)
    r = l if left is right else light(right)
    table = J.rarity(l) if l is r else J.rarity(l, r)
    level = max(threshold, MIN_LEVEL)
    pairs = J.candidates(l, r, level, ("first",), "a.first < b.first" if earlier else None, table)
    floor = jaccard_floor(threshold, boost)
    if boost or level >= 0.5:  # bitmaps tell little at a low similarity
        lb = cut(J.bitmaps(l))
        rb = lb if l is r else cut(J.bitmaps(r))
    if level >= 0.5:
        pairs = J.near_bitmaps(kept(pairs, "text-candidates"), lb, rb, level)
    if boost:
        forth = kept(J.within(l, r, floor, table, "a.first < b.first" if earlier else None).toDF("lk", "rk"), "text-within")
        back = kept(J.within(r, l, floor, table, "b.first < a.first" if earlier else None).toDF("rk", "lk"), "text-within")
        pairs = pairs.union(J.near_bitmaps(forth, lb, rb, floor, "l")).union(J.near_bitmaps(back.select("lk", "rk"), lb, rb, floor, "r")).distinct()
    pairs = kept(pairs, "text-pairs")
    for hashed in {id(x): x for x in (l, r)}.values():
        discard(hashed)
    scored = score_pairs(pairs, _hash_keyed(left, pairs, "lk"), _hash_keyed(right, pairs, "rk"), threshold, boost, ("key",))
    scored = scored.where(F.col("l_first") < F.col("r_first")) if earlier else scored
    return scored.select(F.col("l_key").alias("lk"), F.col("r_key").alias("rk"), "similarity", "l_first", "r_first")


def _hash_keyed(sets: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The texts that are in a pair, by the hash of their key."""
    texts = sets.select(F.xxhash64("k").alias("k"), F.col("k").alias("key"), "first", "low")
    return with_tokens(J.asked(texts, pairs.select(F.col(side).alias("k"))), 1.0)


def score_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, boost: bool = True, extra: tuple[str, ...] = (),
) -> DataFrame:
    """The written (lk, rk) ``pairs`` at or above the threshold, measured on whole texts.

    Pairs carry the text of one side through a shuffle; its tokens are cut after it. A text in many pairs
    is carried as often, so pairs are taken in rounds that carry about as much as all texts have, and the
    shuffles of a round are deleted before the next one.
    """
    chars = [x.select("k", F.length("low").alias("chars")) for x in (left, right)]
    carried = pairs.join(chars[0].withColumnRenamed("k", "lk"), "lk").agg(F.sum("chars")).first()[0] or 0
    rounds = 1
    if carried > ROUND_CHARS:
        texts = sum(x.agg(F.sum("chars")).first()[0] or 0 for x in chars)
        rounds = -(-carried // max(ROUND_CHARS, texts))
    done = []
    for i in range(rounds):
        own, some = (F.pmod(F.xxhash64(c), F.lit(rounds)) == i for c in ("k", "rk"))
        scored = _score(pairs.where(some), left, right.where(own), threshold, boost, extra) if rounds > 1 else _score(pairs, left, right, threshold, boost, extra)
        done.append(kept(scored, "scored-pairs"))
    return reduce(DataFrame.unionByName, done)


def _score(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, boost: bool, extra: tuple[str, ...]) -> DataFrame:
    for side, texts, columns in (("l", left, ("low", "first", *extra)), ("r", right, ("low", "toks", "ntok", "first", *extra))):
        pairs = pairs.join(texts.select(F.col("k").alias(f"{side}k"), *[F.col(c).alias(f"{side}_{c}") for c in columns]), f"{side}k")
    both = J.once(pairs, F.array_distinct(X.tokens("l_low")), "l_toks").withColumn("l_ntok", F.size("l_toks"))
    l_toks = F.when(F.col("l_ntok") == 0, F.array(F.lit(""))).otherwise(F.col("l_toks"))  # as with_tokens
    both = J.once(both, F.size(F.array_intersect(l_toks, "r_toks")), "_shared")
    jac = F.col("_shared") / (F.greatest("l_ntok", F.lit(1)) + F.size("r_toks") - F.col("_shared"))
    both = both.withColumn("jaccard", jac).where(F.col("jaccard") >= jaccard_floor(threshold, boost) - J.EPS)
    sim = F.col("jaccard")
    if boost:
        sim = _boosted(sim, F.col("l_low"), F.col("r_low"), F.col("l_ntok"), F.col("r_ntok"))
    return (
        J.once(both, sim, "similarity").where((F.col("similarity") >= threshold) & (F.col("similarity") > 0))
        .select("lk", "rk", "similarity", "l_first", "r_first", *[f"{side}_{c}" for c in extra for side in "lr"])
    )


def best_match(
    df: DataFrame,
    registry: DataFrame,
    threshold: float = 0.90,
    query: str = "id",
    query_text: str = "signature",
    entry: str = "registry_seq",
    entry_text: str = "signature",
    boost: bool = True,
    both_empty: float = 1.0,
) -> DataFrame:
    """(query, entry, similarity): the most similar entry at or above the threshold.

    The first entry wins a tie. Texts are looked up once per distinct text, and a
    distinct registry text stands for its first entry.
    """
    members, qs = _distinct_texts(df, query, query_text, both_empty)
    _, rs = _distinct_texts(registry, entry, entry_text, both_empty)
    return best_of_pairs(members, similar_texts(qs, rs, threshold, boost), query, entry)


def best_of_pairs(members: DataFrame, sims: DataFrame, query: str, entry: str) -> DataFrame:
    """The best entry of each member's text, the first one among equals."""
    best = sims.groupBy(F.col("lk").alias("k")).agg(
        F.max(F.struct("similarity", (-F.col("r_first")).alias("neg"))).alias("b")
    )
    return members.join(best, "k").select(
        F.col("id").alias(query), (-F.col("b.neg")).alias(entry), F.col("b.similarity").alias("similarity")
    )


def best_match_vector(
    df: DataFrame, registry: DataFrame, threshold: float = 0.90, query: str = "id", query_vector: str = "embedding",
    entry: str = "registry_seq", entry_vector: str = "embedding", exclude_self: bool = False,
) -> DataFrame:
    """As ``best_match`` by cosine; vectors without a direction match nothing."""
    near = knn_join(
        df.select(F.col(query).alias("id"), F.col(query_vector).alias("vec")),
        registry.select(F.col(entry).alias("id"), F.col(entry_vector).alias("vec")),
        k=1, metric="cosine", exclude_self=exclude_self,
    )
    return near.where((F.col("similarity") >= threshold) & (F.col("similarity") > 0)).select(
        F.col("id").alias(query), F.col("neighbour").alias(entry), "similarity"
    )


def skip_seen(df: DataFrame, matches: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(fresh, skipped): rows without a registry match, and rows with theirs."""
    return df.join(matches, key, "left_anti"), df.join(matches, key)


def first_fresh(df: DataFrame, matches: DataFrame, key: str = "id", order: Sequence[str] = ("seq",), n: int = 1) -> DataFrame:
    """The first ``n`` rows, in order, without a registry match: those a run goes on with."""
    return skip_seen(df, matches, key)[0].orderBy(*order).limit(n)


# -- catalog match ----------------------------------------------------------


def match(
    problems: DataFrame,
    catalog: DataFrame,
    method: str = "jaccard",
    threshold: float = 0.4,
    k: int = 3,
    terms: Sequence[str] = V.KEY_TERMS,
    problem: str = "problem_id",
    dataset: str = "dataset_id",
    problem_column: str = "match_text",
    dataset_column: str = "match_text",
    probes: int | None = None,
) -> DataFrame:
    """(problem, dataset, similarity, rank): the ``k`` best at or above the threshold, else the best.

    ``dataset`` is the catalog position: smaller wins a tie. ``method`` is "jaccard", "cosine" or
    "approximate": the cosine of rows in the ``probes`` nearest cells (``ann``; if None, as many as a
    sample of posts needs for a recall of 0.95), for catalogs too large to compare with all; vectors without a direction then match nothing.
    """
    if method in ("cosine", "approximate"):
        p = problems.select(F.col(problem).alias("id"), F.col(problem_column).alias("vec"))
        c = catalog.select(F.col(dataset).alias("id"), F.col(dataset_column).alias("vec"))
    if method == "approximate":
        found = approx_join(p, c, k=k, metric="cosine", probes=probes)
        top = found.select(F.col("id").alias("p"), F.col("neighbour").alias("d"), F.col("similarity").alias("sim"))
    elif method == "cosine":
        found = knn_join(p, c, k=k, metric="cosine", keep_undirected=True).select(
            F.col("id").alias("p"), F.col("neighbour").alias("d"), F.col("similarity").alias("sim")
        )
        top = found
    else:
        top = _match_text(problems, catalog, threshold, k, tuple(terms), problem, dataset, problem_column, dataset_column)
    return _threshold_or_best(top, threshold, k).select(
        F.col("p").alias(problem), F.col("d").alias(dataset), F.col("sim").alias("similarity"), F.col("rank").cast("long").alias("rank")
    )


def _threshold_or_best(pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    w = Window.partitionBy("p").orderBy(F.col("sim").desc(), F.col("d"))
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.where((F.col("sim") >= threshold) | (F.col("rank") == 1))


def _match_text(problems, catalog, threshold, k, terms, problem, dataset, ptext, dtext) -> DataFrame:
    def sets_of(df, ident, text):
        low = df.select(F.col(ident).alias("id"), F.lower(X.blank(text)).alias("low")).withColumn("k", F.md5("low"))
        sets = kept(low.groupBy("k").agg(F.min("low").alias("low")), "distinct-texts")
        sets = sets.select("k", F.array_distinct(X.tokens("low")).alias("toks"), term_mask("low", terms).alias("mask"))
        return low.select("id", "k"), sets

    def classes(members, sets, words):
        """Members and sets of equal size with the same terms and the same of the ``words``: they are equally similar to anything."""
        own = J.only(sets, words).withColumn("toks", F.sort_array("toks"))
        own = kept(own.withColumn("c", F.md5(F.concat_ws(" ", "n", "mask", "toks"))), "text-classes")
        alike = own.groupBy(F.col("c").alias("k")).agg(*[F.first(c).alias(c) for c in ("n", "mask", "toks")])
        return kept(members.join(own.select("k", "c"), "k").select("id", F.col("c").alias("k")), "class-members"), kept(alike, "classes")

    # Everything below works on classes of distinct texts, by the words that posts and entries have in common,
    # and is used several times: write it once.
    p_members, p_sets = sets_of(problems, problem, ptext)
    d_members, d_sets = sets_of(catalog, dataset, dtext)
    words = J.common(p_sets, d_sets)
    p_members, p_sets = classes(p_members, p_sets, words)
    d_members, d_sets = classes(d_members, d_sets, words)
    # Of entries of one class only the first k can be among anyone's k best.
    d_first = cut(first_per_group(d_members, ["k"], ["id"], k))

    # Entries that share no token with a post differ only in the terms they share, of which
    # there are 2^|terms| combinations: the k best per combination cover them.
    by_mask = cut(
        first_per_group(d_first.join(d_sets.select("k", "mask"), "k"), ["mask"], ["id"], k)
        .select("mask", "id", "k")
    )
    combos = F.sequence(F.lit(0), F.lit(2 ** len(terms) - 1))
    p_masks = p_sets.select("mask").distinct().withColumn("d_mask", F.explode(combos))
    best_by_mask = (
        p_masks.join(by_mask.withColumnsRenamed({"mask": "d_mask", "k": "rk"}), "d_mask")
        .withColumn("shared", F.bit_count(F.col("mask").bitwiseAND(F.col("d_mask"))))
    )
    most = best_by_mask.groupBy("mask").agg(F.max("shared").alias("most"))
    fallback = first_per_group(best_by_mask, ["mask"], [F.col("shared").desc(), "id"], k)

    def score(pairs: DataFrame) -> DataFrame:
        checked = J.verify(pairs, p_sets, d_sets, ("mask",))
        sim = _boost_terms(F.col("jaccard"), F.col("l_mask").bitwiseAND(F.col("r_mask")), terms)
        scored = checked.select("lk", "rk", sim.alias("sim"))
        entries = scored.join(d_first.select(F.col("k").alias("rk"), "id"), "rk")
        return first_per_group(
            entries.select(F.col("lk").alias("p"), F.col("id").alias("d"), "sim"),
            ["p"], [F.col("sim").desc(), "d"], k,
        )

    # First pass: all pairs at a similarity that common words alone do not reach.
    usable_p, usable_d = p_sets.where(F.size("toks") > 0), d_sets.where(F.size("toks") > 0)
    table = J.rarity(usable_p, usable_d)
    level = max(min(threshold, 0.2), MIN_LEVEL) if terms else threshold
    seeds = p_sets.join(fallback.select("mask", "rk"), "mask").select(F.col("k").alias("lk"), "rk").distinct()
    pairs = J.candidates(usable_p, usable_d, level, table=table).unionByName(seeds).distinct()
    top = cut(score(pairs))

    # Further rounds: the Jaccard similarity down to which all pairs are known falls. A post stays while
    # a pair below it could change its result, and takes only pairs that still could.
    bound = f"a.bar - {STEP} * bit_count(a.mask & b.mask) - {J.EPS}"
    room = "least(a.n - a.pos, b.n - b.pos)"
    reaches = f"{room} / (a.n + b.n - {room}) >= {bound}"
    for lower in (level / 2, level / 4, MIN_LEVEL):
        need = cut(_open_posts(usable_p, top, most, threshold, k).where(F.col("thr") < level))
        if level <= MIN_LEVEL or need.isEmpty():
            break
        level = max(lower, MIN_LEVEL)
        asked = need.withColumn("thr", F.greatest("thr", F.lit(level)))
        right = usable_d.withColumn("bar", F.lit(0.0))
        more = score(J.candidates(asked, right, carry=("mask", "bar"), where=reaches, table=table))
        top = cut(first_per_group(top.unionByName(more).distinct(), ["p"], [F.col("sim").desc(), "d"], k))
    return p_members.withColumnRenamed("id", "pid").join(top, F.col("k") == F.col("p")).select(
        F.col("pid").alias("p"), "d", "sim"
    )


def _open_posts(posts: DataFrame, top: DataFrame, most: DataFrame, threshold: float, k: int) -> DataFrame:
    """(k, n, toks, mask, bar, thr): what a pair not seen yet needs to change a post's result, and the Jaccard that takes."""
    state = top.groupBy("p").agg(
        F.count_if(F.col("sim") >= threshold).alias("hits"), F.max("sim").alias("best"), F.min("sim").alias("worst"))
    bar = (
        F.when(F.col("hits") >= k, F.col("worst"))
        .when(F.col("hits") > 0, F.lit(threshold))
        .otherwise(F.least(F.col("best"), F.lit(threshold)))
    )
    known = posts.join(F.broadcast(most), "mask").join(state, F.col("k") == F.col("p"))
    return known.select("k", "n", "toks", "mask", bar.alias("bar"), (bar - STEP * F.col("most") - J.EPS).alias("thr"))


# -- text to vector ---------------------------------------------------------


def _words(d: DataFrame, text: str) -> DataFrame:
    return d.withColumn("_words", X.tokens(F.lower(X.blank(text))))


def fit_text_vectors(df: DataFrame, text: str, dims: int = 256):
    """The TF-IDF model of a table, for ``text_vectors`` of several tables."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    stages = [
        HashingTF(numFeatures=dims, inputCol="_words", outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec"),
    ]
    return Pipeline(stages=stages).fit(_words(df, text))


def text_vectors(df: DataFrame, text: str, dims: int = 256, out: str = "embedding", fit_on: DataFrame | None = None, model=None) -> DataFrame:
    """Add TF-IDF vectors as ``array<double>`` of unit length, for use without an encoder.

    They follow ``model`` (``fit_text_vectors``), else one fitted on ``fit_on`` or on the table itself.
    """
    from pyspark.ml.functions import vector_to_array

    model = model or fit_text_vectors(fit_on if fit_on is not None else df, text, dims)
    done = model.transform(_words(df, text))
    return done.withColumn(out, vector_to_array("_vec")).drop("_words", "_tf", "_idf", "_vec")
