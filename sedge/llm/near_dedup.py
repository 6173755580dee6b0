"""Near-duplicates by bottom-k sketches: inverted lists give candidates, union sketches filter them, full sets decide.

A document is the set of 64-bit hashes of its word shingles; its sketch is the k smallest of them under one hash function.
Documents with equal sets form a class first, and only the classes' representatives are compared, so exact copies cost one
row each however many they are.

Candidates come from inverted lists of retained values. Two sets with Jaccard similarity of at least t share at least
``need(n)`` of the values they retain (all they must share if both sketches are whole sets, which holds for n / t <= k; where one of
them may be cut, t * k less SIGMAS standard deviations of a hypergeometric draw, and the smaller of both bounds for n <= k < n / t). So with one order of the values, rarest first, both must share one of their first
kept - need + 1 values; only these generate, and values held by a single representative cannot. A passage that very many
documents share is last in that order and generates only between documents that consist of it for the most part.

What lists hold is linked in rounds: each list's hub is the member with the largest share of values that others hold too, of
equals the longest (a text cut short has nothing of its own either, but is unlike the whole ones), and a member meets the one
such hub of its lists that is most central (a pair per member and round, never all pairs); links are confirmed on full shingle
sets, and components contract. A round that links few is the last. What hubs leave - members that lie outside their list's
largest component - then meets the members of other components over exact prefixes of the full sets, so no link between
components is lost, while members that are already connected are not compared again.

In that last step a shingle at place p of a set of n, rarest first, is the first one shared with a partner only if the partner's
size is at most (1 + t) / t * (n - p) - n, since no more than n - p shingles can be common. Each shingle so carries a window of
sizes, and two sets meet over it only if each lies in the other's window. Sets that hold many shingles of their own
lose all the windows that reach their own size, so thousands of copies that each differ from one text in other places
give next to no pairs of copies, whatever their list's length.

Defined cases: a text with fewer words than a shingle is one shingle; null, empty or blank texts have no shingles and are linked
with nothing; rows that share an id but not a text are linked by the texts of all of them; rows with a null id get the
component of their text's class if the class has an id, else null, and are not kept; repeated rows give repeated results; an empty table gives an empty one;
only the named columns are read. Two different shingles are taken for one if their 64-bit hashes agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.storage import forget, saved
from sedge.llm.common import salted_join
from sedge.llm.textarrays import ascii_words, mixed, powers, slices
from sedge.operators.graph import components

#: Broadcast at most so many candidate ids (8 bytes each); beyond it they meet the texts in a shuffled join.
BROADCAST_IDS = 1_000_000
#: Lists up to this length are paired out at once: at most PAIR_LIST / 2 pairs per member.
PAIR_LIST = 8
HUB_ROUNDS = 2
#: A hub round that links less than this share of the members outside their lists' components is the last one.
LEAST_YIELD = 0.1
SIGMAS = 5.5
#: Sizes in one bin differ by a factor of at most this.
SIZE_BIN = 1.03


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, with repeats, and offsets (n + 1 entries)."""
    words, first = ascii_words(texts)
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    ends = np.cumsum(n)
    start = np.repeat(first[:-1], n) + (np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n))
    last = np.repeat(first[1:], n)
    total = np.zeros(len(start), np.uint64)
    step = powers(1 << 10)
    for j in range(width):
        inside = start + j < last
        part = words[np.minimum(start + j, max(len(words) - 1, 0))] if len(words) else np.empty(0, np.uint64)
        total += np.where(inside, part * step[j], np.uint64(0))
    return mixed(total), np.concatenate(([0], ends)).astype(np.int64)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending, as signed 64-bit values."""
    values, at = shingle_hashes(texts, width)
    values = values.view(np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(values[a:b])


def sketches(docs: DataFrame, *, width: int, k: int) -> DataFrame:
    """(id, text) -> id, n (set size), set_hash (of the whole set), sketch (its k least values)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, hashes, least = [], [], []
            for s in shingle_sets(part.column("text"), width):
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                least.append(s[:k])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in least]))).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(least) if least else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), kept], names=["id", "n", "set_hash", "sketch"])

    return docs.mapInArrow(sketch, "id long, n long, set_hash binary, sketch array<long>")


def need(n: Column, threshold: float, k: int) -> Column:
    """Least number of retained values that a partner of similarity ``threshold`` shares with a set of size n.

    A partner has up to n / threshold shingles and retains k of them at most, so a set that is retained whole may still meet a cut one.
    """
    whole = F.ceil(n * threshold)
    cut = F.floor(F.lit(k * threshold - SIGMAS * math.sqrt(k * threshold * (1 - threshold))))
    least = F.when(n <= threshold * k, whole).when(n <= k, F.least(whole, cut)).otherwise(cut)
    return F.greatest(F.lit(1), least).cast("int")


def generating(reps: DataFrame, *, threshold: float, k: int) -> DataFrame:
    """(value, id, n, core): the values of each representative that generate candidates, and its share of values that others hold too."""
    postings = reps.select("id", "set_hash", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    lists = saved(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "list-sizes")
    held = salted_join(postings, lists, "value", size="df", salt=["id"])
    per_set = held.groupBy("id", "set_hash").agg(F.max("n").alias("n"), F.max("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    first = F.col("kept") - need(F.col("n"), threshold, k) + 1  # so many values, of which the unshared ones come first
    some = per_set.withColumn("take", first - (F.col("kept") - F.size("v"))).filter("take > 0")
    core = (F.size("v") / F.col("kept")).alias("core")
    return some.select("id", "n", core, F.explode(F.slice("v", F.lit(1), F.col("take"))).alias("p")).select("p.value", "id", "n", "core").distinct()


def _size_fits(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


def union_estimate(k: int):
    """Of two sketches: similarity estimated on the k least values of their union, and how many values that are."""

    def estimate(sa: Column, sb: Column) -> tuple[Column, Column]:
        union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, k)
        both = F.array_intersect(F.array_intersect(sa, sb), union)
        return F.size(both) / F.greatest(F.lit(1), F.size(union)), F.size(union)

    return estimate


def _with_both(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """``pairs`` with what ``of_a`` and ``of_b`` have of their ids. A hub is in a pair with each member of its lists: its pairs are dealt by the member."""
    out = pairs
    for key, other, what in (("a", "b", of_a), ("b", "a", of_b)):
        out = salted_join(out, what, key, size="_pairs", salt=[other], sizes=pairs.groupBy(key).agg(F.count("*").alias("_pairs")))
    return out


def filtered(pairs: DataFrame, reps: DataFrame, *, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule the threshold out; a margin of SIGMAS standard deviations is left."""
    sa = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    sb = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    share, size = union_estimate(k)(F.col("sa"), F.col("sb"))
    both = _with_both(pairs, sa, sb).withColumn("share", share).withColumn("size", size)
    slack = F.lit(SIGMAS * math.sqrt(threshold * (1 - threshold))) / F.sqrt(F.greatest(F.lit(1), F.col("size")))
    # Sketches of at most k values are whole sets, so their similarity is known, however many values both have together.
    common = F.size(F.array_intersect("sa", "sb"))
    known = common >= (threshold - 1e-9) * (F.col("na") + F.col("nb") - common)
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    return both.filter(F.when(whole, known).otherwise(F.col("share") >= threshold - slack)).select("a", "b")


def full_sets(docs: DataFrame, ids: DataFrame, *, width: int) -> DataFrame:
    """(id, shingles) of the documents named in ``ids``, from their whole texts."""
    n = ids.count()
    some = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            each = list(shingle_sets(part.column("text"), width))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("id"), values], names=["id", "shingles"])

    return some.mapInArrow(sets, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B| on the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(p, q, assume_unique=True))
                good.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    xa = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    xb = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    return _with_both(pairs, xa, xb).select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, k: int = 128) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (least id with the same set), component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = saved(sketches(texts, width=width, k=k), "sketches")
    classes = saved(made.filter("n > 0").groupBy("set_hash").agg(F.min("id").alias("class_id"), F.count("*").alias("rows")), "classes")
    first = classes.filter("class_id IS NOT NULL").select(F.col("class_id").alias("id"), "set_hash")
    # A class may hold its least id twice; either row's sketch will do.
    reps = saved(made.join(first, ["id", "set_hash"]).dropDuplicates(["id", "set_hash"]).select("id", "set_hash", "n", "sketch"), "representatives")
    parts = components(links(reps, texts, percent=percent, width=width, k=k), src="a", dst="b")
    placed = saved(classes.join(parts.select(F.col("node").alias("class_id"), "component"), "class_id", "left"), "classes")
    out = salted_join(made.select("id", "n", "set_hash"), placed, "set_hash", size="rows", salt=["id"], how="left")
    component = F.coalesce("component", "class_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), "class_id", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join on ids; they are broadcast while there are at most BROADCAST_IDS of them."""
    named = ids.select(F.col("id").alias(id_col))
    return docs.join(F.broadcast(named) if named.count() <= BROADCAST_IDS else named, id_col, how)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the least id. Rows with a null id stay."""
    verdict = saved(near_duplicates(docs, id_col=id_col, **options).select("id", "kept").filter("id IS NOT NULL"), "near-verdict")
    dropped = saved(verdict.filter("NOT kept").select("id").distinct(), "near-dropped")
    twice = saved(verdict.filter("kept").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "near-twice")
    out = _by_ids(docs, dropped, id_col, "left_anti").select(docs.columns)
    if twice.isEmpty():
        return out
    once = _by_ids(docs, twice, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns)
    return _by_ids(out, twice, id_col, "left_anti").select(docs.columns).unionByName(once)


def links(reps: DataFrame, texts: DataFrame, *, percent: int, width: int, k: int) -> DataFrame:
    """Confirmed links (a, b) between representatives whose components are those of all links."""
    threshold = percent / 100
    made = saved(generating(reps, threshold=threshold, k=k), "lists")
    sizes = saved(made.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1"), "list-sizes")
    lists = saved(salted_join(made, sizes, "value", size="m", salt=["id"]), "lists-shared")
    ids = saved(lists.select("id").distinct(), "list-ids")
    active = saved(reps.join(ids, "id", "left_semi"), "active")
    sets = saved(full_sets(texts, ids, width=width), "full-sets")
    forget(made, sizes, ids)

    def verified(pairs: DataFrame) -> DataFrame:
        candidates = saved(_ordered(pairs), "pairs")
        likely = saved(filtered(candidates, active, threshold=threshold, k=k), "likely-pairs")
        good = saved(confirmed(likely, sets, percent=percent), "good-pairs")
        forget(candidates, likely)
        return good

    def with_hub(members: DataFrame, hubs: DataFrame) -> DataFrame:
        met = salted_join(members.drop("m"), hubs, "value", size="m", salt=["id"]).filter("component <> hc")
        best = F.min(F.struct("away", (-F.col("hn")).alias("short"), "hub")).alias("h")
        return met.filter(_size_fits("n", "hn", threshold)).groupBy(F.col("id").alias("a")).agg(best).select("a", F.col("h.hub").alias("b"))

    def hubs_of(members: DataFrame) -> DataFrame:
        # A text cut short holds nothing of its own either, so of the most central the longest.
        central = F.min(F.struct((-F.col("core")).alias("away"), (-F.col("n")).alias("short"), "id", "n", "component")).alias("h")
        chosen = members.groupBy("value").agg(central, F.max("m").alias("m"))
        return saved(chosen.select("value", "m", F.col("h.away").alias("away"), F.col("h.id").alias("hub"), F.col("h.n").alias("hn"), F.col("h.component").alias("hc")), "hubs")

    small, large = lists.filter(F.col("m") <= PAIR_LIST), lists.filter(F.col("m") > PAIR_LIST)
    other = small.select("value", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = small.withColumnRenamed("id", "a").join(other, "value").filter("a < b").filter(_size_fits("n", "nb", threshold)).select("a", "b")
    alone = large.withColumn("component", F.col("id"))
    hubs = hubs_of(alone)
    edges = verified(pairs.unionByName(with_hub(alone, hubs)))
    forget(hubs)
    turn, open_lists = 0, None
    while turn <= HUB_ROUNDS:
        parts = components(edges, src="a", dst="b")
        # A list whose members are in one component stays so; only the open ones are looked at again.
        held = large if open_lists is None else open_lists.drop("component", "outside", "top")
        members = held.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        members = saved(members, "members")
        forget(open_lists)
        sums = members.groupBy("value", "component").agg(F.count("*").alias("c"))
        most = sums.groupBy("value").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("parts")).filter("parts > 1")
        most = saved(most.select("value", "m", F.col("top.component").alias("top")), "list-tops")
        open_lists = saved(salted_join(members.drop("m"), most, "value", size="m", salt=["id"]).withColumn("outside", F.col("component") != F.col("top")), "open-lists")
        forget(members, most)
        outside = open_lists.filter("outside")
        if outside.isEmpty():
            break
        found = []
        if turn < HUB_ROUNDS:
            hubs = hubs_of(outside)
            found.append(verified(with_hub(open_lists, hubs)))
            forget(hubs)
            if found[0].count() < LEAST_YIELD * outside.select("id").distinct().count():  # the next hubs would link as few
                turn = HUB_ROUNDS
        if turn >= HUB_ROUNDS:
            found.append(verified(_left_over(open_lists, sets, percent=percent)))
        turn += 1
        both = edges
        for more in found:
            both = both.unionByName(more)
        both = saved(both.distinct(), "links")
        forget(edges, *found)
        edges = both
    forget(lists, active, sets, open_lists)
    return edges


def size_window(percent: int) -> tuple[Column, Column]:
    """Least and largest size of a partner whose first common shingle is one after which ``left`` of a set's ``n`` shingles come (itself counted)."""
    n, left = F.col("n"), F.col("left")
    least = F.ceil(n * percent / F.lit(100))
    most = F.least(F.floor(n * 100 / F.lit(percent)), F.floor((left * (100 + percent) - n * percent) / F.lit(percent)))
    return least.cast("long"), most.cast("long")


def size_bin(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_BIN)).cast("int")


def _left_over(open_lists: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """Pairs (a, b) that may still link members outside their lists' largest component to others; see the module's text."""
    who = saved(open_lists.groupBy("id").agg(F.max("n").alias("n"), F.max("component").alias("component"), F.max("outside").alias("outside")), "open-members")
    postings = sets.join(who.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("value"))
    often = saved(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "shingle-sizes")
    shared = salted_join(postings, often, "value", size="df", salt=["id"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    places = shared.select("id", F.size("v").alias("size"), F.posexplode("v").alias("at", "p")).select("id", F.col("p.value").alias("value"), (F.col("size") - F.col("at")).cast("long").alias("left"))
    least, most = size_window(percent)
    placed = places.join(who, "id").withColumn("least", least).withColumn("most", most).filter("most >= least")
    placed = saved(placed.select("value", "id", "n", "component", "outside", "least", "most"), "placed")
    # Of a pair the smaller set must lie in the larger one's window, up to its own size, and the larger one in the smaller one's.
    lower = placed.filter("most >= n").select("value", size_bin(F.col("n")).alias("bin"), *[F.col(c).alias(f"l_{c}") for c in ("id", "n", "component", "outside", "most")])
    upper = placed.withColumn("to", F.least("most", "n")).withColumn("bin", F.explode(F.sequence(size_bin(F.col("least")), size_bin(F.col("to")))))
    fits = F.col("l_n").between(F.col("least"), F.col("to")) & (F.col("n") <= F.col("l_most")) & (F.col("component") != F.col("l_component"))
    # Of a pair at least one is outside; members inside their lists' largest components, which are many, do not meet each other.
    some = lower.filter("l_outside").join(upper, ["value", "bin"]).filter(fits)
    rest = lower.filter("NOT l_outside").join(upper.filter("outside"), ["value", "bin"]).filter(fits)
    return some.unionByName(rest).select(F.col("l_id").alias("a"), F.col("id").alias("b"))
