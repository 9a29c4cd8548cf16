"""Parent-child rows to full hierarchies, by peeling leaves from below and assigning from above in reverse order.

A round takes away the nodes that have no children left. Every third round also shortens chains (runs of nodes with one
parent each, whose parents have no other child left): the nodes inside a run leave at once, and its lowest node hangs
directly on its highest, so many steps below; pointers that double their reach find both. Leaves and chains together
halve any tree in a few rounds, however deep it is. What neither takes away lies on a cycle or above one; runs that
close on themselves come out as cycles at once.

Where only roots are asked for, runs of nodes with one parent are drawn together before anything is peeled.

Going up the rounds, each node sends its list of descendants, itself among them, to its parents and to the nodes inside
the runs it hangs on; what has come to a node by its round is complete. Going back down, each node takes over the
roots of its parents, once. Lists travel as rows, as that of a root with a third of all nodes would not fit into a task,
and as pairs of which only the fewest steps are kept. Nothing is solved in one task, and no plan depends on sizes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut, cut_counted, release

#: Chains are shortened every so many rounds; between, leaves are taken alone, which is cheaper.
SHORTEN = 3


def term_key(term: Column) -> Column:
    """Prefix and number of a term id, however written; null if it has none."""
    m = F.regexp_extract(term, r"^\s*(?:\S*[/#])?([A-Za-z]+)\s*[:_\s]\s*0*(\d+)", 1)
    n = F.regexp_extract(term, r"^\s*(?:\S*[/#])?([A-Za-z]+)\s*[:_\s]\s*0*(\d+)", 2)
    return F.when(n != "", F.concat(F.upper(m), F.lit(":"), n))


def term_edges(terms: DataFrame, id_col: str = "id", parents_col: str = "parents") -> tuple[DataFrame, DataFrame]:
    """(nodes: id), (edges: child, parent). Parents that name no row are left out, as are null ids; repeats count once."""
    rows = terms.select(F.col(id_col).alias("id"), F.col(parents_col).alias("parents")).where("id is not null")
    nodes = rows.select("id").distinct()
    named = nodes.select(F.col("id").alias("parent"), term_key(F.col("id")).alias("key")).where("key is not null")
    wanted = rows.select(F.col("id").alias("child"), F.explode("parents").alias("p")).select("child", term_key(F.col("p")).alias("key")).where("key is not null").distinct()
    return nodes, wanted.join(named, "key").select("child", "parent").distinct()


@dataclass
class Round:
    """Nodes that leave (child) with the nodes they hang on (parent) so many steps above; `inner`: (child, parent, node,
    at) nodes left out between, `at` steps below the parent. In a round of chains `inner` holds whole chains by parent."""

    ups: DataFrame
    inner: DataFrame | None
    chains: bool = False


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffled hash tables: dozens of rounds must not leave as many broadcasts with the driver."""
    return left.join(right.hint("shuffle_hash"), on, how)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shorten(live: DataFrame, inner: DataFrame | None):
    """Takes the nodes inside chains out of the live edges (child, parent, steps): (live, inner, the round, nodes of runs
    that close on themselves), or None where there are none."""
    single = live.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("steps").alias("steps")).where("n = 1").drop("n")
    lone = live.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select("parent")
    chain = cut(_meet(single, lone, "parent").select("child", "parent", "steps"))
    below = chain.select(F.col("parent").alias("child"))
    if _meet(chain, below, "child", "left_semi").isEmpty():
        return None
    ends, left = chain.select("child", F.col("parent").alias("top"), "steps"), None
    while True:  # pointers twice as long each time; those of open runs come to an end, those of closed ones go round
        hop = ends.select(F.col("child").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"))
        moved = F.col("top2").isNotNull()
        ends, n = cut_counted(_meet(ends, hop, "top", "left").select("child", F.coalesce("top2", "top").alias("top"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), moved.alias("moved")), moved=F.col("moved"))
        now = n["moved"]
        if now == 0 or now == left:
            break
        ends, left = ends.drop("moved"), now
    closed = ends.where("moved").select("child")
    done = ends.where("not moved").drop("moved")
    inside = cut(_meet(done, below, "child", "left_semi").select("child", F.col("top").alias("parent"), "steps"))
    lowest = _meet(done, below, "child", "left_anti").select("child", F.col("top").alias("parent"), "steps")
    new = cut(_meet(live, chain.select("child"), "child", "left_anti").select("child", "parent", "steps").unionByName(lowest))
    spans = _meet(inside.withColumnRenamed("child", "node"), lowest.select("child", "parent"), "parent").select("child", "parent", "node", F.col("steps").alias("at"))
    loops = closed.select(F.col("child").alias("node"))
    if inner is not None:  # nodes left out before get the new ends of their edge
        shifted = _meet(_meet(inner.drop("parent"), done.select("child", "top", F.col("steps").alias("far")), "child"), chain.select("child", F.col("steps").alias("own")), "child")
        shifted = shifted.select("node", F.col("top").alias("parent"), (F.col("at") + F.col("far") - F.col("own")).alias("at"))
        spans = spans.unionByName(_meet(shifted, lowest.select("child", "parent"), "parent").select("child", "parent", "node", "at"))
        loops = loops.unionByName(_meet(inner, closed, "child", "left_semi").select("node"))
    spans = cut(spans)
    kept = spans if inner is None else spans.unionByName(_meet(inner, chain.select("child"), "child", "left_anti"))
    return new, cut(kept), Round(inside, spans, True), cut(loops) if now else None


def peel(edges: DataFrame, shorten: int = SHORTEN) -> tuple[list[Round], DataFrame | None, DataFrame | None]:
    """(rounds in the order in which nodes leave, nodes that lie on cycles or above, nodes of cycles found as closed runs) of edges
    (child, parent, steps). Nodes without parents leave with their last child and are in no round. `shorten`: rounds between two that
    shorten chains, 0 for none."""
    live = edges
    rounds: list[Round] = []
    inner, loops, turn = None, [], 0
    while True:
        turn += 1
        above = live.select(F.col("parent").alias("child"), F.lit(True).alias("above")).distinct()
        marked, n = cut_counted(_meet(live, above, "child", "left"), leaves=F.col("above").isNull(), others=F.col("above").isNotNull())
        live = marked.where("above").drop("above")
        if n["leaves"]:
            leaves = marked.where("above is null").drop("above")
            rounds.append(Round(leaves, None if inner is None else _meet(inner, leaves.select("child"), "child", "left_semi")))
            inner = None if inner is None else _meet(inner, leaves.select("child"), "child", "left_anti")
        if not n["others"]:
            return rounds, None, _all(loops) if loops else None
        if n["leaves"] and (not shorten or turn % shorten):
            continue
        shorter = _shorten(live, inner) if shorten else None
        if shorter is not None:
            live, inner, chains, closed = shorter
            rounds.append(chains)
            if closed is not None:
                loops.append(closed)
        elif not n["leaves"]:
            nodes = live.select(F.explode(F.array("child", "parent")).alias("node"))
            rest = nodes if inner is None else nodes.unionByName(inner.select("node"))
            return rounds, cut(rest.distinct()), _all(loops) if loops else None


def _grow(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, origin, steps): fewest steps from each origin to every node reached over edges, a round a step."""
    found = front = cut(start)
    step = 0
    while not front.isEmpty():
        step += 1
        reached = front.join(edges.withColumnRenamed("parent", "node"), "node").select(F.col("child").alias("node"), "origin").distinct()
        front = cut(reached.join(found.select("node", "origin"), ["node", "origin"], "left_anti").select("node", "origin", F.lit(step).cast("long").alias("steps")))
        found = found.unionByName(front)
        if step % 4 == 0:
            found = cut(found)
    return cut(found)


def _cyclic(edges: DataFrame) -> DataFrame:
    """(node, colour): nodes that are their own ancestors, those of one knot with one colour, by joins: peel from above too, then part after part take the greatest id that
    reaches each node, and within its nodes walk back from it."""
    while True:
        kept = cut(edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
        if kept.count() == edges.count():
            break
        edges = kept
    loops = edges.where("child = parent").select(F.col("child").alias("node"), F.col("child").alias("colour"))
    found = []
    edges = kept.where("child <> parent")
    while not edges.isEmpty():
        colour = cut(edges.select(F.explode(F.array("child", "parent")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            push = _meet(edges, colour.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "colour")
            new = cut(colour.unionByName(push).groupBy("node").agg(F.max("colour").alias("colour")))
            if _meet(new, colour, ["node", "colour"], "left_anti").isEmpty():
                break
            colour = new
        inner = cut(edges.join(colour.withColumnsRenamed({"node": "child", "colour": "c1"}), "child").join(colour.withColumnsRenamed({"node": "parent", "colour": "c2"}), "parent").where("c1 = c2").select("child", "parent", F.col("c1").alias("colour")))
        part = front = cut(colour.where("node = colour"))
        while True:
            up = _meet(inner, front.withColumnRenamed("node", "child"), ["child", "colour"]).select(F.col("parent").alias("node"), "colour").distinct()
            front = cut(_meet(up, part, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            part = cut(part.unionByName(front))
        release(edges.sparkSession)
        found.append(cut(part.join(part.groupBy("colour").count().where("count > 1"), "colour", "left_semi").select("node", "colour")))
        rest = inner.join(part.select(F.col("node").alias("child")), "child", "left_anti").join(part.select(F.col("node").alias("parent")), "parent", "left_anti")
        edges = cut(rest.select("child", "parent"))
    for part in found:
        loops = loops.unionByName(part)
    return loops.distinct()


def _send(rounds: list[Round], start: DataFrame) -> list[DataFrame]:
    """(node, item, steps) that come to nodes when each in its round sends on what it has to the nodes it hangs on and
    those left out between. `start`: (node, item, steps), what nodes have from the beginning."""
    sent: list[DataFrame] = []
    for r in rounds:
        mine = r.ups.select(F.col("child").alias("node")).distinct()
        lists = _meet(_all([start, *sent]), mine, "node", "left_semi").groupBy(F.col("node").alias("child"), "item").agg(F.min("steps").alias("steps"))
        up = r.ups.withColumnRenamed("steps", "far")
        to = [up.select("child", F.col("parent").alias("node"), "far")]
        if r.inner is not None:
            on = ["parent"] if r.chains else ["child", "parent"]
            spans = r.inner.select(*on, "node", "at")
            to.append(_meet(up, spans, on).where("at < far").select("child", "node", (F.col("far") - F.col("at")).alias("far")))
        sent.append(cut(_meet(_all(to), lists, "child").groupBy("node", "item").agg(F.min(F.col("steps") + F.col("far")).alias("steps"))))
    return sent


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"), *[c for c in edges.columns if c not in ("child", "parent")])


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between some nodes."""
    return cut(_meet(_meet(edges, nodes.withColumnRenamed("node", "child"), "child", "left_semi"), nodes.withColumnRenamed("node", "parent"), "parent", "left_semi"))


def _spread(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, item, steps) with the fewest steps when (node, item, steps) go down edges (child, parent, steps), a round a step."""
    known, moved = start.withColumn("new", F.lit(True)), 1
    while moved:
        ahead = _meet(edges.withColumnRenamed("steps", "far"), known.where("new").withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "item", (F.col("steps") + F.col("far")).alias("steps"), F.lit(None).cast("long").alias("old"))
        both = known.select("node", "item", "steps", F.col("steps").alias("old")).unionByName(ahead).groupBy("node", "item").agg(F.min("steps").alias("steps"), F.min("old").alias("old"))
        known, n = cut_counted(both.select("node", "item", "steps", (F.col("old").isNull() | (F.col("steps") < F.col("old"))).alias("new")), new=F.col("new"))
        moved = n["new"]
    release(edges.sparkSession)
    return known.drop("new")


def _runs(single: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(child, top, steps): nodes with one parent (child, top, steps: 1) and the first node above them that has none or
    several; and (node): those on cycles of such nodes, if there are any. Pointers double their reach each round; ends
    that are found leave the rounds, so that a root with very many nodes below it is met once."""
    ended: list[DataFrame] = []
    open_, left, reach = single, None, 1
    while True:
        hop = _all([open_, *ended]).select(F.col("child").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"))
        moved = F.col("top2").isNotNull()
        both, n = cut_counted(_meet(open_, hop, "top", "left").select("child", F.coalesce("top2", "top").alias("top"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), moved.alias("moved")), moved=F.col("moved"))
        ended.append(both.where("not moved").drop("moved"))
        open_, now, reach = both.where("moved").drop("moved"), n["moved"], 2 * reach
        if now == 0:
            return _all(ended), None
        if now == left and reach >= now:  # all that are left go round, and have gone far enough to stand on their cycle
            return _all(ended), cut(open_.select(F.col("top").alias("node")).distinct())
        left = now


def roots(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, origin, steps): each root a node reaches over its parents, with the fewest steps, a root itself with 0; and
    (node): the nodes that are their own ancestors. `nodes`: (id), `edges`: (child, parent), both without repeats.

    Runs of nodes with one parent each are drawn together first; what is peeled are the nodes with several parents,
    over the runs between them. Nodes on cycles and above are peeled once more, from above; what then remains are the
    cycles. Rounds grow with the number of nodes with several parents one above the other, not with the depth. Empty
    tables give empty results; a node without parents is its own root; self-parents are cycles."""
    edges = cut(edges.select("child", "parent"))
    counted = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n"), F.first("parent").alias("parent"))
    up = cut(_meet(nodes.select(F.col("id").alias("node")), counted, "node", "left"))
    one = F.lit(1).cast("long").alias("steps")
    single = up.where("n = 1").select(F.col("node").alias("child"), F.col("parent").alias("top"), one)
    runs, loops = _runs(single)
    release(nodes.sparkSession)
    ways = _meet(edges, up.where("n > 1").select(F.col("node").alias("child")), "child", "left_semi")
    ways = _meet(ways, runs.select(F.col("child").alias("parent"), F.col("top"), F.col("steps").alias("more")), "parent", "left")
    ways = cut(_meet(ways, single.select(F.col("child").alias("parent"), F.lit(True).alias("run")), "parent", "left").where("run is null or top is not null").select("child", F.coalesce("top", "parent").alias("parent"), (F.coalesce("more", F.lit(0)) + 1).alias("steps"), F.when(F.col("run"), F.col("parent")).alias("by")))
    links = cut(ways.groupBy("child", "parent").agg(F.min("steps").alias("steps")))
    rounds, rest, _ = peel(links, 0)
    release(nodes.sparkSession)
    top = up.where("n is null").select("node", F.col("node").alias("item"), F.lit(0).cast("long").alias("steps"))
    found, cyclic = [top], [] if loops is None else [loops]
    if rest is not None:
        tangle = _within(links, rest)
        found.append(_spread(_meet(top, rest, "node", "left_semi"), tangle).where("steps > 0"))
        release(nodes.sparkSession)
        _, core, _ = peel(_turned(tangle), 0)
        release(nodes.sparkSession)
        if core is not None:
            knots = cut(_cyclic(_within(tangle, core).select("child", "parent")))
            cyclic.append(knots.select("node"))
            mine = _meet(_meet(ways.where("by is not null"), knots.withColumnRenamed("node", "child"), "child"), knots.withColumnRenamed("node", "parent"), ["parent", "colour"])
            # nodes of the runs between nodes of one knot, walked upwards
            walk = mine.select(F.col("by").alias("node"), F.lit("").alias("item"), F.lit(0).cast("long").alias("steps")).distinct()
            cyclic.append(_spread(walk, single.join(runs.select("child"), "child", "left_semi").join(single.select(F.col("child").alias("top")), "top", "left_semi").select(F.col("top").alias("child"), F.col("child").alias("parent"), F.lit(0).cast("long").alias("steps"))).select("node"))
    met = cut(_all(found))
    release(nodes.sparkSession)
    for r in reversed(rounds):  # one table throughout, so that every round runs the same compiled plan
        taken = _meet(r.ups.withColumnRenamed("steps", "more"), met.withColumnRenamed("node", "parent"), "parent")
        met = cut(met.unionByName(taken.groupBy(F.col("child").alias("node"), "item").agg(F.min(F.col("steps") + F.col("more")).alias("steps"))))
    release(nodes.sparkSession)
    along = runs.withColumnRenamed("steps", "more").join(met.withColumnRenamed("node", "top"), "top").select(F.col("child").alias("node"), "item", (F.col("steps") + F.col("more")).alias("steps"))
    return met.unionByName(along).withColumnRenamed("item", "origin"), cut(_all(cyclic).distinct()) if cyclic else up.select("node").limit(0)


def closure(nodes: DataFrame, edges: DataFrame, turned: bool = False) -> DataFrame:
    """(node, below, steps): every node with itself and each of its descendants, with the fewest steps. As large as its
    result; of a chain of n nodes that is n * n / 2 rows.

    `turned`: the edges are those of nodes on cycles and above, upside down, so that what remains are the cycles."""
    nodes, edges = cut(nodes.select(F.col("id").alias("node"))), cut(edges.select("child", "parent"))
    rounds, rest, loops = peel(edges.withColumn("steps", F.lit(1).cast("long")))
    own = nodes.select("node", F.col("node").alias("item"), F.lit(0).cast("long").alias("steps"))
    sent = _send(rounds, own)
    fewest = lambda parts: _all(parts).groupBy("node", F.col("item").alias("below")).agg(F.min("steps").alias("steps"))
    knots = [x for x in (rest, loops) if x is not None]
    if not knots:
        return fewest([own, *sent])
    rest = cut(_all(knots).distinct())
    tangle = _within(edges, rest)
    if turned:
        inside = _grow(rest.select("node", F.col("node").alias("origin"), F.lit(0).cast("long").alias("steps")), tangle).select(F.col("origin").alias("node"), F.col("node").alias("item"), "steps")
    else:
        inside = closure(rest.withColumnRenamed("node", "id"), _turned(tangle), True).select(F.col("below").alias("node"), F.col("node").alias("item"), "steps")
    parts = [own, inside]
    if sent:  # what came to nodes on cycles and above goes on to all that reach them
        came = _all(sent).join(rest, "node", "left_semi").select(F.col("node").alias("through"), "item", F.col("steps").alias("more"))
        inside = cut(inside)
        parts = [own, inside, _all(sent).join(rest, "node", "left_anti"), inside.withColumnRenamed("item", "through").join(came, "through").select("node", "item", (F.col("steps") + F.col("more")).alias("steps"))]
    return fewest(parts)


def under(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, start, steps): all that lies below the few nodes (start) asked for, themselves included, by a walk down from these."""
    return _grow(nodes.select("node", F.col("node").alias("origin"), F.lit(0).cast("long").alias("steps")), edges).withColumnRenamed("origin", "start")


def ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, above, steps): the nodes asked for with themselves and all their ancestors, by a walk up from these alone."""
    turned = cut(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    return _grow(nodes.select("node", F.col("node").alias("origin"), F.lit(0).cast("long").alias("steps")).distinct(), turned).select(F.col("origin").alias("node"), F.col("node").alias("above"), "steps")


def standings(terms: DataFrame, id_col: str = "id", parents_col: str = "parents") -> DataFrame:
    """(term_id, standing, root_id, n_steps): 'cycle' for a term that is its own ancestor, else 'rooted' for every root
    it reaches, else 'stray'."""
    nodes, edges = term_edges(terms, id_col, parents_col)
    found, cyclic = roots(nodes, edges)
    # one pass: a term's roots, or the one row that says why it has none
    told = nodes.select(F.col("id").alias("node")).join(cyclic.withColumn("loop", F.lit(True)), "node", "left").join(found, "node", "left")
    loop, rooted = F.coalesce("loop", F.lit(False)), F.col("origin").isNotNull()
    standing = F.when(loop, "cycle").when(rooted, "rooted").otherwise("stray")
    rows = told.select(F.col("node").alias("term_id"), standing.alias("standing"), F.when(~loop & rooted, F.col("origin")).otherwise("").alias("root_id"), F.when(~loop & rooted, F.col("steps")).otherwise(-1).cast("int").alias("n_steps"))
    once = rows.where("standing = 'cycle'").distinct()
    return rows.where("standing <> 'cycle'").unionByName(once)


def descendants(terms: DataFrame, id_col: str = "id", parents_col: str = "parents") -> DataFrame:
    """(ancestor, descendant, n_steps) of every pair, itself included, with the fewest steps."""
    return closure(*term_edges(terms, id_col, parents_col)).select(F.col("node").alias("ancestor"), F.col("below").alias("descendant"), F.col("steps").cast("int").alias("n_steps"))


def profiles(terms: DataFrame, id_col: str = "id", parents_col: str = "parents") -> DataFrame:
    """(term_id, root_id, depth, path, n_descendants) of every term that reaches a root: its nearest root (the first id
    of these), the steps to it and a path of that length, root first, joined by '>', which at every step takes the first
    id of the parents it may; n_descendants, the size of its subtree, leaves out the term itself."""
    nodes, edges = term_edges(terms, id_col, parents_col)
    nodes, edges = cut(nodes), cut(edges)
    rooted, _ = roots(nodes, edges)
    best = cut(rooted.groupBy("node").agg(F.min(F.struct("steps", "origin")).alias("b")).select("node", "b.origin", "b.steps"))
    above = best.select(F.col("node").alias("parent"), F.col("origin").alias("origin_up"), F.col("steps").alias("steps_up"))
    step = edges.join(best.withColumnRenamed("node", "child"), "child").join(above, "parent").where("origin = origin_up and steps = steps_up + 1").groupBy("child").agg(F.min("parent").alias("parent"))
    # pointers twice as long each round, with what they pass written out
    ways = cut(best.join(step.withColumnRenamed("child", "node"), "node", "left").select("node", F.col("parent").alias("to"), F.col("node").alias("path")))
    while not ways.where("to is not null").isEmpty():
        far = ways.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("path").alias("head"))
        ways = cut(ways.join(far, "to", "left").select("node", F.col("next").alias("to"), F.concat_ws(">", "head", "path").alias("path")))
    sizes = closure(nodes, edges).groupBy("node").agg((F.count("*") - 1).alias("n_descendants"))
    return best.join(ways.select("node", "path"), "node").join(sizes, "node").select(F.col("node").alias("term_id"), F.col("origin").alias("root_id"), F.col("steps").cast("int").alias("depth"), "path", "n_descendants")
