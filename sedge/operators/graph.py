"""Reference graphs: edges from texts, ranks, components, closures, order. Iterative operators write each round to the shared folder."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.joins import containment_join, dealt
from sedge.functions.storage import forget, saved, saved_with

#: So many nodes and edges at most meet in the one task that peels them or finds their cycles.
SMALL_REST = 1_000_000
#: So many targets of a node at most lie in one row of a list.
LIST_MOST = 1_000
#: About so many votes meet in a task.
VOTES_MOST = 500_000


def reference_edges(clauses: DataFrame, *, doc: str, src: str, text: str, number: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Edges (doc, src, dst, rel_type) from phrases: ``rules`` are (pattern with one group, type); the target is the document's clause of that number."""
    found = None
    for pattern, kind in rules:
        hits = clauses.select(doc, src, F.lit(kind).alias("rel_type"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("_ref"))
        found = hits if found is None else found.unionByName(hits)
    targets = clauses.groupBy(doc, F.col(number).cast("string").alias("_ref")).agg(F.min(src).alias("dst"))
    return found.join(targets, [doc, "_ref"]).filter(F.col(src) != F.col("dst")).select(doc, src, "dst", "rel_type")


def reference_table(clauses: DataFrame, *, doc: str, src: str, text: str, number: str, rules: Sequence[tuple[str, str]], strength: float = 0.9, around: int = 50) -> DataFrame:
    """``reference_edges`` with strength and context: ``around`` characters on either side of the phrase's first place in the text."""
    edges = reference_edges(clauses, doc=doc, src=src, text=text, number=number, rules=rules)
    numbers = clauses.groupBy(doc, F.col(number).cast("string").alias("_ref")).agg(F.min(src).alias("dst"))
    places = None
    for pattern, kind in rules:
        # Of several references of a type the context is that of the one to this number: the phrase up to the number, then no further digit.
        refs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))
        hits = clauses.filter(F.col(text).rlike(pattern)).select(doc, src, F.lit(kind).alias("rel_type"), F.col(text).alias("_t"), F.explode(refs).alias("_ref"))
        own = F.concat(F.lit(pattern[: re.search(r"\((?!\?)", pattern).start()]), F.lit("\\Q"), F.col("_ref"), F.lit("\\E(?![0-9]|\\.[0-9])"))
        at = F.regexp_instr("_t", own)
        long = F.length(F.regexp_substr("_t", own))
        begin = F.greatest(F.lit(1), at - around)
        hits = hits.select(doc, src, "rel_type", "_ref", F.substring("_t", begin, at + long + around - begin).alias("context"))
        places = hits if places is None else places.unionByName(hits)
    context = places.join(numbers, [doc, "_ref"]).groupBy(doc, src, "dst", "rel_type").agg(F.min("context").alias("context"))
    return edges.distinct().join(context, [doc, src, "dst", "rel_type"], "left").withColumn("strength", F.lit(strength))


def title_edges(refs: DataFrame, docs: DataFrame, *, phrase: str, id: str, title: str, ordinal: str) -> DataFrame:
    """Resolve each distinct phrase to the first document whose title contains it."""
    phrases = refs.select(phrase, F.lower(phrase).alias("_p")).distinct()
    hits = containment_join(docs.select(id, F.lower(title).alias("_t"), ordinal), phrases, text="_t", phrase="_p")
    best = hits.groupBy(phrase).agg(F.min_by(id, ordinal).alias("target"))
    return refs.join(best, phrase, "left").withColumn("resolved", F.col("target").isNotNull())


def unresolved_refs(refs: DataFrame, docs: DataFrame, *, doc: str, phrase: str, id: str, title: str, ordinal: str) -> DataFrame:
    """(doc, phrase, issue_type, severity): references of a document that name no document there is."""
    resolved = title_edges(refs.select(doc, phrase).distinct(), docs, phrase=phrase, id=id, title=title, ordinal=ordinal)
    return resolved.filter("NOT resolved").select(doc, phrase, F.lit("unresolved_reference").alias("issue_type"), F.lit("medium").alias("severity"))


def resolve_references(refs: DataFrame, docs: DataFrame, *, by: str, ref: str, id: str, title: str, ordinal: str, is_exhibit: Column) -> DataFrame:
    """``refs`` with target and how: the first document of the same set (``by``) whose title lies in the reference's text ("title"); failing that, the first exhibit
    whose title holds the id that follows the word exhibit ("exhibit"); else null, null. Letters' case does not count; null and empty titles name nothing."""
    said = saved(refs.select(by, ref).filter(F.col(ref).isNotNull()).distinct().withColumn("_r", F.lower(ref)), "references")
    named = docs.select(by, F.col(id).alias("_id"), F.lower(title).alias("_t"), F.col(ordinal).alias("_o"), F.coalesce(is_exhibit, F.lit(False)).alias("_x"))
    first = F.min_by("_id", F.struct("_o", "_id"))
    by_title = containment_join(said, named, text="_r", phrase="_t", by=[by]).groupBy(by, ref).agg(first.alias("_by_title"))
    letters = said.withColumn("_e", F.regexp_extract("_r", r"exhibit\s+([a-z0-9]+)", 1)).filter("_e <> ''").select(by, ref, "_e")
    by_letter = containment_join(named.filter("_x"), letters, text="_t", phrase="_e", by=[by]).groupBy(by, ref).agg(first.alias("_by_letter"))
    out = refs.join(by_title, [by, ref], "left").join(by_letter, [by, ref], "left")
    how = F.when(F.col("_by_title").isNotNull(), "title").when(F.col("_by_letter").isNotNull(), "exhibit")
    return out.withColumn("target", F.coalesce("_by_title", "_by_letter")).withColumn("how", how).drop("_by_title", "_by_letter")


#: References from a clause to a clause of another document: the document's name, the clause's number.
OTHER_DOCUMENTS = (r"(?i)(?:as defined in|pursuant to)\s+(?:the\s+)?([A-Za-z0-9_]+\s+(?:agreement|lease|amendment))\s+section\s+([0-9]+(?:\.[0-9]+)*)", r"(?i)((?:exhibit|schedule)\s+[A-Z0-9]+)\s+section\s+([0-9]+(?:\.[0-9]+)*)")


def cross_document_edges(clauses: DataFrame, docs: DataFrame, *, by: str, doc: str, src: str, text: str, number: str, title: str, ordinal: str, patterns: Sequence[str] = OTHER_DOCUMENTS) -> DataFrame:
    """Edges (by, doc, src, other_doc, dst): a clause that names another document of its set and a clause's number there. The document is the first whose title
    contains the name; references to no document, to no clause there, or to the clause itself are left out."""
    found = None
    for pattern in patterns:
        names, numbers = (F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g)) for g in (1, 2))
        hits = clauses.select(by, doc, src, F.explode(F.array_distinct(F.arrays_zip(names.alias("name"), numbers.alias("ref")))).alias("_m"))
        hits = hits.select(by, doc, src, F.lower(F.regexp_replace("_m.name", r"\s+", " ")).alias("_name"), F.col("_m.ref").alias("_ref"))
        found = hits if found is None else found.unionByName(hits)
    found = saved(found.distinct(), "other-documents")
    titled = docs.select(by, F.col(doc).alias("other_doc"), F.lower(title).alias("_t"), F.col(ordinal).alias("_o"))
    named = containment_join(titled, found.select(by, "_name").distinct(), text="_t", phrase="_name", by=[by]).groupBy(by, "_name").agg(F.min_by("other_doc", F.struct("_o", "other_doc")).alias("other_doc"))
    targets = clauses.groupBy(F.col(by), F.col(doc).alias("other_doc"), F.col(number).cast("string").alias("_ref")).agg(F.min(src).alias("dst"))
    out = found.join(named, [by, "_name"]).join(targets, [by, "other_doc", "_ref"])
    return out.filter((F.col(doc) != F.col("other_doc")) | (F.col(src) != F.col("dst"))).select(by, doc, src, "other_doc", "dst").distinct()


def relations(nodes: DataFrame, rels: DataFrame, *, doc: str, node: str, target: str, kind: str | None = None) -> DataFrame:
    """Per (document, node) its related nodes in order (with the type, if ``kind`` names its column), where both ends exist."""
    ends = nodes.select(doc, node).distinct()
    ok = rels.join(ends, [doc, node], "left_semi").join(ends.withColumnRenamed(node, target), [doc, target], "left_semi")
    item = F.col(target) if kind is None else F.struct(target, kind)
    return ok.groupBy(doc, node).agg(F.array_sort(F.collect_list(item)).alias("related"))


def degrees(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    ends = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _target_lists(e: DataFrame, name: str) -> DataFrame:
    """(src, to) of distinct edges (src, dst): the targets of each node, LIST_MOST in a row at most."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return saved(e.withColumn("_part", F.floor((place - 1) / LIST_MOST)).groupBy("src", "_part").agg(F.collect_list("dst").alias("to")).select("src", "to"), name)


def pagerank(edges: DataFrame, *, src: str = "src", dst: str = "dst", rounds: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(node, rank): at most ``rounds`` rounds, fewer once no rank moves by more than ``tolerance``; the mass of nodes without successors is shared by all. Every round is a table.
    Edges with a null end are left out."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    lists = _target_lists(e, "pr-lists")  # a round sorts and joins lists, not edges
    nodes = saved(degrees(lists.select("src", F.explode("to").alias("dst"))).select("node", "out_degree"), "pr-nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    before = None
    for i in range(rounds):
        share = rank.filter("out_degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share"))
        given = lists.join(share, "src").select(F.explode("to").alias("dst"), "share").groupBy("dst").agg(F.sum("share").alias("got"))
        loose = rank.agg(F.sum(F.when(F.col("out_degree") == 0, F.col("rank")))).first()[0] or 0.0
        new = rank.join(given, F.col("node") == F.col("dst"), "left")
        stepped = new.select("node", "out_degree", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))).alias("rank"), F.col("rank").alias("_before"))
        if tolerance is not None:
            stepped, n_moved = saved_with(stepped, "pr-rank", F.count_if(F.abs(F.col("rank") - F.col("_before")) > tolerance))
        else:
            stepped, n_moved = saved(stepped.drop("_before"), "pr-rank"), 1
        if before is not None:
            forget(before)
        rank = before = stepped
        if not n_moved:
            break
    return rank.select("node", "rank")


def hubs(edges: DataFrame, *, top_n: int = 10, **options) -> DataFrame:
    """The top_n nodes by rank with their in-degree; ties by node."""
    src, dst = options.get("src", "src"), options.get("dst", "dst")
    e = saved(edges.select(src, dst).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct(), "hub-edges")
    top = saved(pagerank(e, **options).withColumn("rank", F.round("rank", 9)).orderBy(F.desc("rank"), "node").limit(top_n), "hubs")  # the degrees of these alone are counted
    held = F.broadcast(top.select("node")) if top_n <= 100_000 else top.select("node")
    entered = e.join(held, F.col(dst) == F.col("node"), "left_semi").groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("_in"))
    return top.join(entered, "node", "left").select("node", "rank", F.coalesce("_in", F.lit(0)).cast("long").alias("in_degree")).orderBy(F.desc("rank"), "node")


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable. Nodes without edges to others are not listed.

    Each round points every node to its smallest neighbour, follows the pointers to their roots and contracts the graph to
    the roots; at least half of the nodes of each component with edges go in a round. Each step is a table, so lineage stays short.
    """
    n_rows = F.count(F.lit(1))
    e, left = saved_with(edges.filter(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct(), "cc-edges", n_rows)
    members = None
    while left:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "cc-to")
        moved = 1
        while moved:
            up = to.select(F.col("node").alias("to"), F.col("to").alias("up"))
            jump = to.join(up, "to").select("node", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved"))
            jumped, moved = saved_with(jump, "cc-jump", F.count_if("moved"))
            forget(to)
            to = jumped
        to_root = to.select("node", "to")
        up = to_root.select(F.col("node").alias("to"), F.col("to").alias("up"))
        ends = e.join(to_root.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(to_root.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b").filter("ra <> rb")
        fewer, left = saved_with(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges", n_rows)
        forget(e)
        e = fewer
        if members is None:
            members = to
        else:
            next_members = saved(members.select("node", "to").join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to")), "cc-members")
            forget(members, to)
            members = next_members
    if members is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.select("node", F.col("to").alias("component"))


def label_propagation(edges: DataFrame, *, src: str = "src", dst: str = "dst", rounds: int = 5) -> DataFrame:
    """(node, community): each node takes its neighbours' most frequent label, ties to the smallest, for fixed rounds.

    A node sends its label to its list of neighbours; a node's votes meet in one task, of VOTES_MOST votes or one node's.
    """
    both = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).unionByName(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"))).filter("src <> dst")
    e, n = saved_with(both.distinct(), "lp-edges", F.count(F.lit(1)))
    tasks = -(-n // VOTES_MOST) or 1
    lists = _target_lists(e.repartition(tasks, "src"), "lp-lists")
    forget(e)
    label = lists.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        sent = lists.join(label.withColumnRenamed("node", "src"), "src").select(F.explode("to").alias("node"), "community")
        votes = sent.repartition(tasks, "node").groupBy("node", "community").agg(F.count("*").alias("c"))
        label = saved(votes.groupBy("node").agg(F.min(F.struct((-F.col("c")).alias("c"), "community")).alias("m")).select("node", F.col("m.community").alias("community")), "lp-labels")
    return label


def dependency_closure(edges: DataFrame, *, src: str = "src", dst: str = "dst", depth: int = 2) -> DataFrame:
    """(src, dst, hops): targets reachable in at most ``depth`` steps with the least number of steps."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    level = e.withColumn("hops", F.lit(1))
    every = level
    for i in range(2, depth + 1):
        level = level.select("src", F.col("dst").alias("_m")).join(e.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct().withColumn("hops", F.lit(i))
        every = every.unionByName(level)
    return every.groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def conflicts(df: DataFrame, *, keys: Sequence[str], order: str, differ: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs i < j of a key whose values differ: the first of ``differ`` (column, reason) that does.

    The result is the pairs, so it grows with the square of a key's rows; ``conflict_groups`` says the same in one row per value.
    """
    a = df.select(*keys, F.col(order).alias("a"), *[F.col(c).alias(f"a_{c}") for c, _ in differ])
    b = df.select(*keys, F.col(order).alias("b"), *[F.col(c).alias(f"b_{c}") for c, _ in differ])
    reason = None
    for c, name in differ:
        hit = F.col(f"a_{c}") != F.col(f"b_{c}")
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return a.join(b, list(keys)).filter("a < b").withColumn("reason", reason).filter("reason IS NOT NULL").select(*keys, "a", "b", "reason")


def conflict_groups(df: DataFrame, *, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """(keys, values, n_rows, first, n_groups) of keys whose rows do not agree: two rows conflict exactly if they lie in different groups of their key."""
    groups = df.groupBy(*keys, *values).agg(F.count("*").alias("n_rows"), F.min(order).alias("first"))
    n = groups.groupBy(*keys).agg(F.count("*").alias("n_groups")).filter("n_groups > 1")
    return groups.join(n, list(keys))


def _peel(block: DataFrame, edges: DataFrame, *, last: bool) -> DataFrame:
    """(node, level) of a block of bounded size (node, base), peeled in one task. A node that waits for one that is never free gets no row, -1 if this block is the ``last`` one.

    ``edges`` are all edges left that lead into the block, and ``base`` is the level that nodes done before give.
    """

    def peel(table: pa.Table) -> pa.Table:
        is_node = pc.is_null(table["dst"])
        own, arcs = table.filter(is_node), table.filter(pc.invert(is_node))
        nodes, level = own["src"].combine_chunks(), own["base"].to_numpy().copy()
        src, dst = (pc.index_in(arcs[c], value_set=nodes).fill_null(-1).to_numpy() for c in ("src", "dst"))
        waits = np.bincount(dst, minlength=len(nodes))
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        begin, end = (np.searchsorted(src, np.arange(len(nodes)), side) for side in ("left", "right"))
        done, free = np.zeros(len(nodes), bool), np.flatnonzero(waits == 0)
        while len(free):
            done[free] = True
            n = end[free] - begin[free]
            to = dst[np.repeat(begin[free] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            np.maximum.at(level, to, np.repeat(level[free] + 1, n))
            np.subtract.at(waits, to, 1)
            met = np.unique(to)
            free = met[waits[met] == 0]
        if last:
            level[~done], done = -1, np.ones(len(nodes), bool)
        return pa.table({"node": nodes.filter(pa.array(done)), "level": pa.array(level[done], pa.int32())})

    kind = block.schema["node"].dataType.simpleString()
    rows = block.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"), "base").unionByName(edges.select("src", "dst", F.lit(0).alias("base")))
    return rows.groupBy().applyInArrow(peel, f"node {kind}, level int")


def topo_levels(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level): longest path from a node without predecessors; nodes on or behind a cycle get level -1.

    Each round takes the nodes that wait for the fewest others, with the edges into them SMALL_REST rows at most, and one task peels as many levels of them as it can; if the free
    nodes alone are more, they are taken without a task. What is done gives its levels to the nodes behind it, and its edges go. No free node: the rest lies on or behind cycles.
    """
    n_rows = F.count(F.lit(1))
    e = saved(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "topo-edges")
    waits = F.coalesce(F.sum(F.when(F.col("s").isNotNull(), 1)), F.lit(0)).alias("waits")
    ends = e.select(F.col("dst").alias("node"), F.col("src").alias("s")).unionByName(e.select(F.col("src").alias("node"), F.lit(None).alias("s")))
    left, n_left = saved_with(ends.filter("node IS NOT NULL").groupBy("node").agg(waits).withColumn("base", F.lit(0)), "topo-nodes", n_rows)
    e, n_edges = saved_with(e.filter("src IS NOT NULL AND dst IS NOT NULL"), "topo-edges", n_rows)
    done = None
    for turn in itertools.count():
        if n_left + n_edges <= SMALL_REST:
            rest = _peel(left.select("node", "base"), e, last=True)
            break
        sizes = left.groupBy("waits").agg(F.sum(F.col("waits") + 1).alias("n"))  # as many rows as there are in-degrees, less than the root of twice the edges
        most = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("waits"))).filter(F.col("upto") <= SMALL_REST).agg(F.max("waits")).first()[0]
        if most is None:
            step = left.filter("waits = 0").select("node", F.col("base").alias("level"))
        else:
            block = left.filter(F.col("waits") <= most).select("node", "base")
            step = _peel(block, e.join(block.select(F.col("node").alias("dst")), "dst", "left_semi"), last=False)
        step, n_step = saved_with(step, "topo-step", n_rows)
        if not n_step:
            rest = left.select("node", F.lit(-1).alias("level"))
            break
        done = step if done is None else done.unionByName(step)
        if turn % 50 == 49:
            done = saved(done, "topo-done")
        given = e.join(step.select(F.col("node").alias("src"), "level"), "src").groupBy(F.col("dst").alias("node")).agg(n_rows.alias("n"), F.max("level").alias("top"))
        stay = left.join(step.select("node"), "node", "left_anti").join(given, "node", "left")
        fewer, n_left = saved_with(stay.select("node", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.greatest("base", F.col("top") + 1).alias("base")), "topo-nodes", n_rows)
        kept, n_edges = saved_with(e.join(step.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"), "topo-edges", n_rows)
        forget(left, e)
        left, e = fewer, kept
    return rest if done is None else done.unionByName(rest)


def reading_positions(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level, place): nodes in the order of their levels, numbered from 1 within a level; nodes on or behind a cycle have level -1 and are
    numbered by in-degree, then out-degree. Ties go by node."""
    found = topo_levels(edges, src=src, dst=dst).join(degrees(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()), "node")
    on_cycle = F.col("level") < 0
    w = Window.partitionBy("level").orderBy(F.when(on_cycle, F.col("in_degree")), F.when(on_cycle, F.col("out_degree")), "node")
    return found.select("node", "level", F.row_number().over(w).alias("place"))


def _strong_parts(table: pa.Table) -> pa.Table:
    """(node, component) of the strongly connected components of edges (src, dst) that have more than one node."""
    out: dict = {}
    for s, d in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
        out.setdefault(s, []).append(d)
    index, low, stack, held, nodes, names = {}, {}, [], set(), [], []
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    held.add(n)
                    work.append((n, iter(out.get(n, ()))))
                    break
                if n in held:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        held.discard(members[-1])
                    if len(members) > 1:
                        nodes += members
                        names += [min(members)] * len(members)
    return pa.table({"node": pa.array(nodes, table.schema.field("src").type), "component": pa.array(names, table.schema.field("src").type)})


def _cycles_of_rest(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components of a rest of bounded size, found in one task."""
    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy().applyInArrow(_strong_parts, f"node {kind}, component {kind}")


def _cycles_of_sets(e: DataFrame, sets: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """((node, component) of the sets that no edge enters or leaves, the ``n`` edges' rest, its number of rows). ``sets`` (node, set) may lack nodes; a node of several sets counts to the least.

    A cycle through a closed set lies in it, so whole sets are dealt over as many tasks as the number of edges asks for. A set of more than SMALL_REST edges is of the rest.
    """
    of = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("set").alias("set"))
    placed = e.join(of.select(F.col("node").alias("src"), F.col("set").alias("s")), "src", "left").join(of.select(F.col("node").alias("dst"), F.col("set").alias("d")), "dst", "left")
    placed = saved(placed.select("src", "dst", "s", "d"), "scc-placed")
    crossing = F.col("s").isNull() | F.col("d").isNull() | (F.col("s") != F.col("d"))
    ends = placed.filter(crossing).select(F.explode(F.array("s", "d")).alias("s")).filter("s IS NOT NULL")
    large = placed.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL_REST).select("s").filter("s IS NOT NULL")
    opened = saved(ends.unionByName(large).distinct(), "scc-open-sets")
    inside = placed.filter(~crossing)
    closed = inside.join(opened, "s", "left_anti").select("src", "dst", "s")
    rest = placed.filter(crossing).select("src", "dst").unionByName(inside.join(opened, "s", "left_semi").select("src", "dst"))
    kind = e.schema["src"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if whole := list(batches):
            yield from _strong_parts(pa.Table.from_batches(whole)).to_batches()

    found = saved(dealt(closed, "s", rows=n).select("src", "dst").mapInArrow(find, f"node {kind}, component {kind}"), "scc-closed")
    rest, n_rest = saved_with(rest, "scc-edges", F.count(F.lit(1)))
    forget(placed, opened)
    return found, rest, n_rest


def cycle_members(edges: DataFrame, *, src: str = "src", dst: str = "dst", trims: int = 3, sets: DataFrame | None = None) -> DataFrame:
    """(node, component): the nodes that reach themselves, with the least node of their strongly connected component. Nodes before or behind a cycle are not listed.

    Each turn trims edges that start where nothing enters or end where nothing leaves, colours every node by the least node that reaches it (a round per step of
    the longest path that still changes a colour), and goes back from each colour's own node through its colour: what it meets both ways is one component. Components and edges between
    colours go; the rest takes another turn. Every step is a table, edges are never gathered; once SMALL_REST edges at most are left, one task finds the rest.
    Where most edges stay inside known sets of nodes, ``sets`` (node, set) saves these turns: sets without edges to others are done first, each in one task.
    """
    n_rows = F.count(F.lit(1))
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    loops = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    e, left = saved_with(e.filter("src <> dst").distinct(), "scc-edges", n_rows)
    found = None
    if sets is not None:
        found, inner, left = _cycles_of_sets(e, sets, left)
        forget(e)
        e = inner
    while left > SMALL_REST:
        for _ in range(trims):
            kept, n_kept = saved_with(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc-edges", n_rows)
            forget(e)
            e, left, less = kept, n_kept, n_kept < left
            if not less:
                break
        if left <= SMALL_REST:
            break
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        colour, moved = saved(nodes.withColumn("colour", F.col("node")), "scc-colour"), 1
        while moved:
            given = e.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("got"))
            step = colour.join(given, F.col("node") == F.col("dst"), "left").select("node", F.least("colour", "got").alias("colour"), F.coalesce(F.col("got") < F.col("colour"), F.lit(False)).alias("moved"))
            step, moved = saved_with(step, "scc-colour", F.count_if("moved"))
            forget(colour)
            colour = step
        ends = e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        inner = saved(ends.filter("c = cd").select("src", "dst", "c"), "scc-inner")
        front = saved(colour.filter("node = colour").select("node", F.col("colour").alias("component")), "scc-front")
        members, more = front, 1
        while more:
            back = inner.join(front, (F.col("dst") == F.col("node")) & (F.col("c") == F.col("component"))).select(F.col("src").alias("node"), "component").distinct()
            front, more = saved_with(back.join(members, ["node", "component"], "left_anti"), "scc-front", n_rows)
            members = saved(members.unionByName(front), "scc-members") if more else members
        whole = members.join(members.groupBy("component").agg(n_rows.alias("_n")).filter("_n > 1"), "component", "left_semi").select("node", "component")
        found = whole if found is None else found.unionByName(whole)
        taken = members.select("node")
        rest = inner.join(taken.select(F.col("node").alias("src")), "src", "left_anti").join(taken.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        e, left = saved_with(rest, "scc-edges", n_rows)
    if left:
        small = _cycles_of_rest(e)
        found = small if found is None else found.unionByName(small)
    return loops if found is None else found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def modularity(edges: DataFrame, members: DataFrame, *, src: str = "src", dst: str = "dst", node: str = "node", community: str = "community") -> DataFrame:
    """(n_communities, modularity) of a partition of the undirected simple graph, one row: the share of edges inside communities less what degrees alone would give."""
    e = edges.filter(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    of = members.select(F.col(node).alias("_n"), F.col(community).alias("_c"))
    ends = e.join(of.select(F.col("_n").alias("a"), F.col("_c").alias("ca")), "a").join(of.select(F.col("_n").alias("b"), F.col("_c").alias("cb")), "b")
    per = ends.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).alias("inside")), F.struct(F.col("cb").alias("c"), F.lit(False).alias("inside")))).alias("x")).groupBy("x.c").agg(F.count("*").alias("d"), F.count_if("x.inside").alias("inside"))
    total = per.agg(F.sum("d").alias("d2"))  # one row
    scored = per.crossJoin(F.broadcast(total)).select((2 * F.col("inside") / F.col("d2") - F.pow(F.col("d") / F.col("d2"), 2)).alias("q"))
    return scored.agg(F.count("*").alias("n_communities"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def refined_communities(edges: DataFrame, *, src: str = "src", dst: str = "dst", start: DataFrame | None = None, rounds: int = 20) -> tuple[DataFrame, list[float]]:
    """((node, community), score after each round kept). From ``start`` (node, community; each node alone if none), local moves raise the modularity.

    In a round the nodes of one of two halves, dealt anew by a hash in every round, each move to the neighbouring community with the largest gain, ties to the least community; the others stay. Moves of one
    round are made at once, so the score may fall: such a round is taken back, and two of them in a row end the search. The score so never falls.
    """
    e = edges.filter(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    both = saved(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "mod-edges")
    degree = saved(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k")), "mod-degrees")
    m2 = both.count()
    of = degree.select("node", F.col("node").alias("community"))
    if start is not None:
        of = of.select("node", F.col("community").alias("_own")).join(start.select("node", "community"), "node", "left").select("node", F.coalesce("community", "_own").alias("community"))
    of = saved(of, "mod-communities")
    score = lambda x: modularity(both, x, src="a", dst="b").first()["modularity"]
    scores = [score(of)]
    failed = 0
    for i in range(rounds):
        weight = of.join(degree, "node").groupBy("community").agg(F.sum("k").alias("sum"))
        links = both.join(of.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count("*").alias("links"))
        own = of.join(degree, "node").select("node", F.col("community").alias("own"), "k")
        open_to = own.join(links, "node").join(weight, "community").withColumn("others", F.col("sum") - F.when(F.col("own") == F.col("community"), F.col("k")).otherwise(0))
        gain = F.col("links") - F.col("k") * F.col("others") / m2
        stay = own.join(weight.withColumnRenamed("community", "own"), "own").join(links.select("node", F.col("community").alias("own"), F.col("links").alias("at_home")), ["node", "own"], "left").select("node", (F.coalesce("at_home", F.lit(0)) - F.col("k") * (F.col("sum") - F.col("k")) / m2).alias("home"))
        best = open_to.groupBy("node").agg(F.min(F.struct((-gain).alias("away"), "community")).alias("x")).join(stay, "node").filter((-F.col("x.away") > F.col("home") + 1e-12) & (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0))
        moved = saved(of.join(best.select("node", F.col("x.community").alias("to")), "node", "left").select("node", F.coalesce("to", "community").alias("community")), "mod-communities")
        new = score(moved)
        if new > scores[-1]:
            forget(of)
            of, failed = moved, 0
            scores.append(new)
        else:
            forget(moved)
            failed += 1
            if failed == 2:
                break
    return of.select("node", "community"), scores


def type_counts(edges: DataFrame, types: DataFrame, *, kind: str) -> DataFrame:
    """Count of edges per type of a dimension, zero counts included."""
    return types.select(kind).distinct().join(edges.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def graph_tables(nodes: DataFrame, edges: DataFrame, *, node: str, src: str, dst: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(node table, edge table) to export: nodes with n_out, n_in and n_types; edges whose ends both exist, numbered copies (n) of the same (src, dst, kind) in one row."""
    ok, _ = valid_edges(edges, nodes, src=src, dst=dst, node=node)
    rows = saved(ok.groupBy(src, dst, kind).agg(F.count("*").alias("n")), "edge-table")
    ends = rows.select(F.col(src).alias("_n"), "n", F.lit(0).alias("_i"), kind).unionByName(rows.select(F.col(dst).alias("_n"), F.lit(0).cast("long").alias("n"), F.col("n").alias("_i"), kind))
    sums = ends.groupBy("_n").agg(F.sum("n").alias("n_out"), F.sum("_i").alias("n_in"), F.countDistinct(kind).alias("n_types"))
    out = nodes.join(sums, F.col(node) == F.col("_n"), "left").drop("_n")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_out", "n_in", "n_types")}), rows


def valid_edges(edges: DataFrame, nodes: DataFrame, *, src: str, dst: str, node: str) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends both exist, edges with an unknown end)."""
    known = nodes.select(F.col(node)).distinct()
    ok = edges.join(known.withColumnRenamed(node, src), src, "left_semi").join(known.withColumnRenamed(node, dst), dst, "left_semi")
    bad = edges.join(known.withColumnRenamed(node, src), src, "left_anti").unionByName(edges.join(known.withColumnRenamed(node, src), src, "left_semi").join(known.withColumnRenamed(node, dst), dst, "left_anti"))
    return ok, bad


def docset_issues(docs: DataFrame, edges: DataFrame, *, id: str, date: str, is_base: str) -> DataFrame:
    """Orphans (no edge, not base) and edges whose source is dated before its target: (issue, id)."""
    used = edges.select(F.col("src").alias(id)).unionByName(edges.select(F.col("dst").alias(id))).distinct()
    orphans = docs.filter(~F.col(is_base)).join(used, id, "left_anti").select(F.lit("orphan").alias("issue"), id)
    dated = edges.join(docs.select(F.col(id).alias("src"), F.col(date).alias("_s")), "src").join(docs.select(F.col(id).alias("dst"), F.col(date).alias("_d")), "dst")
    early = dated.filter("_s < _d").select(F.lit("dated_before_target").alias("issue"), F.col("src").alias(id)).distinct()
    return orphans.unionByName(early)


def docset_audit(docs: DataFrame, edges: DataFrame, refs: DataFrame, *, by: str, id: str, title: str, ordinal: str, date: str, is_base: str, is_exhibit: str, ref: str, to_exhibit: str) -> DataFrame:
    """Everything that is wrong with sets of documents: (issue, id, detail).

    Orphans and wrong dates as ``docset_issues`` has them; "on_cycle" for documents whose amendments (``edges``) lead back to them, with the cycle's least document;
    "missing_exhibit" and "unresolved_reference" for references (of ``refs``, by the flag ``to_exhibit``) that ``resolve_references`` cannot resolve, with the reference's text.
    """
    docs = saved(docs.select(*dict.fromkeys((by, id, title, ordinal, date, is_base, is_exhibit))), "docset-docs")
    edges = saved(edges.select("src", "dst").distinct(), "docset-edges")
    plain = docset_issues(docs, edges, id=id, date=date, is_base=is_base).withColumn("detail", F.lit(None).cast("string"))
    cycles = cycle_members(edges, sets=docs.select(F.col(id).alias("node"), F.col(by).alias("set"))).select(F.lit("on_cycle").alias("issue"), F.col("node").alias(id), F.col("component").cast("string").alias("detail"))
    open_refs = resolve_references(refs, docs, by=by, ref=ref, id=id, title=title, ordinal=ordinal, is_exhibit=F.col(is_exhibit)).filter("target IS NULL")
    missing = open_refs.select(F.when(F.col(to_exhibit), "missing_exhibit").otherwise("unresolved_reference").alias("issue"), F.col(id), F.col(ref).alias("detail")).distinct()
    return plain.unionByName(cycles).unionByName(missing)


def term_dictionary(terms: DataFrame, *, term: str, definition: str, date: str, ordinal: str) -> DataFrame:
    """Newest definition per term (null dates oldest), number of definitions, whether they conflict."""
    newest = F.max_by(definition, F.struct(F.col(date), -F.col(ordinal)))
    out = terms.groupBy(term).agg(newest.alias("definition"), F.countDistinct(definition).alias("n_definitions"))
    return out.withColumn("conflicting", F.col("n_definitions") > 1)


def neighbours(chunks: DataFrame, *, doc: str, order: str, text: str, context: int = 500) -> DataFrame:
    """Add before and after: the end of the chunk before and the start of the chunk after."""
    w = Window.partitionBy(doc).orderBy(order)
    return chunks.withColumn("before", F.right(F.lag(text).over(w), F.lit(context))).withColumn("after", F.left(F.lead(text).over(w), F.lit(context)))


def clause_nodes(clauses: DataFrame, *, field: str, key: str, risky: Column) -> DataFrame:
    """Add section (field before its first dot), kind (key before its first underscore), risk."""
    return clauses.withColumn("section", F.split_part(F.col(field), F.lit("."), F.lit(1))).withColumn("kind", F.split_part(F.col(key), F.lit("_"), F.lit(1))).withColumn("risk", F.when(risky, "high").otherwise("low"))
