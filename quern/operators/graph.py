"""Entity graphs of texts and word analogies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.joins import join_counted
from quern.operators.dedup import persisted
from quern.operators.retrieval import cosine, top_k


def entities(docs: DataFrame, gazetteer: list[str]) -> DataFrame:
    """``doc_id``, ``entity``, ``at`` (first position from 0), ``size`` of the text: names found in any letter case."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.filter(F.array(*[F.struct(F.lit(e).alias("entity"), (F.instr(low, e.lower()) - 1).alias("at")) for e in sorted(gazetteer)]), lambda x: x["at"] >= 0)
    return docs.select("doc_id", F.char_length(low).alias("size"), F.explode(found).alias("f")).select("doc_id", "size", "f.*")


def relations(found: DataFrame) -> DataFrame:
    """``doc_id``, ``a`` < ``b``, ``weight`` = max(0.1, 1 - distance / text length): names that meet in a text."""
    left = found.select("doc_id", "size", F.col("entity").alias("a"), F.col("at").alias("pa"))
    right = found.select("doc_id", F.col("entity").alias("b"), F.col("at").alias("pb"))
    met = left.join(right, "doc_id").where("a < b")
    return met.select("doc_id", "a", "b", F.greatest(F.lit(0.1), 1 - F.abs(F.col("pa") - F.col("pb")) / F.col("size")).alias("weight"))


def edges(met: DataFrame) -> DataFrame:
    return met.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_docs"))


def communities(links: DataFrame, rounds: int = 10) -> DataFrame:
    """``node``, ``community`` by weighted label propagation: a node takes the heaviest label around it, ties the smallest.

    Labels of all nodes change at once, so rounds are bounded; the name of a community is its smallest member.
    """
    both = links.select("a", "b", "weight").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = persisted(both.unionAll(both.groupBy("a").agg(F.max("weight").alias("weight")).select("a", F.col("a").alias("b"), "weight")))
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        sums = both.join(labels, both["b"] == labels["node"]).groupBy("a", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        new = persisted(sums.groupBy("a").agg(F.max("w").alias("w")).join(sums, ["a", "w"]).groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "node"))
        same = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count() == 0
        labels = new
        if same:
            break
    named = persisted(labels.groupBy("label").agg(F.min("node").alias("community"), F.count("*").alias("_rows")))
    return join_counted(labels, named, ["label"]).select("node", "community")


def adjacency(links: DataFrame) -> DataFrame:
    """``a``, ``b``, ``weight`` in both directions: parallel links are added up, links of a node to itself left out."""
    rows = links.where("a is not null and b is not null and a <> b and weight is not null").select("a", "b", F.col("weight").cast("double").alias("weight"))
    return rows.unionAll(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


@dataclass
class _Level:
    """A graph of one level: links both ways (``a``, ``b``, ``weight``), ``nodes`` (node, k: degree by weight, _rows: links), the
    weight inside nodes (both ways), and half the total weight of all levels."""

    links: DataFrame
    nodes: DataFrame
    inner: float
    m: float
    n_links: int

    def placed(self, labels: DataFrame, resolution: float) -> tuple[DataFrame, float]:
        """``node``, ``label``, ``to``, ``w``: the weight from each node to each community around it, and the objective: the sum
        over communities of (weight inside) / m - resolution * (degrees / 2m)^2. A node of very many links is broadcast to them."""
        known = self.nodes.select("node", "_rows").join(labels, "node")
        pairs = self.links
        for end, name in (("a", "label"), ("b", "to")):
            pairs = join_counted(pairs, known.toDF(end, "_rows", name), [end], total=self.n_links).drop("_rows")
        near = persisted(pairs.groupBy(F.col("a").alias("node"), "label", "to").agg(F.sum("weight").alias("w")))
        sizes = labels.join(self.nodes, "node").groupBy("label").agg(F.sum("k").alias("s"))
        parts = near.where("label = to").agg(F.sum("w").alias("inside")).crossJoin(sizes.agg(F.sum(F.pow(F.col("s") / (2 * self.m), F.lit(2.0))).alias("expected")))
        row = parts.first()
        return near, ((row["inside"] or 0.0) + self.inner) / (2 * self.m) - resolution * (row["expected"] or 0.0)


def _level(links: DataFrame, nodes: DataFrame, inner: float, m: float) -> _Level:
    links = persisted(links)
    ends = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("_rows"))
    known = persisted(nodes.join(ends, "node", "left").select("node", "k", F.coalesce("_rows", F.lit(0)).cast("long").alias("_rows")))
    return _Level(links, known, inner, m, links.count())


def _bottom(links: DataFrame, total: str) -> _Level:
    if total not in ("weight", "count"):
        raise ValueError("total must be weight or count")
    both = persisted(adjacency(links))
    row = both.agg(F.sum("weight").alias("weight"), F.count("*").alias("count")).first()
    return _level(both, both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k")), 0.0, float(row[total] or 0) / 2)


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0, total: str = "weight") -> float:
    """Modularity of ``node``, ``community`` on weighted links. ``total="count"`` divides by the number of links instead of their weight."""
    level = _bottom(links, total)
    return level.placed(labels.select("node", F.col("community").alias("label")), resolution)[1] if level.m else 0.0


def _gains(near: DataFrame, labels: DataFrame, level: _Level, resolution: float) -> DataFrame:
    """``node``, ``label``, ``to``, ``gain``: each node's best move to a neighbour's community that raises the objective; ties
    go to the smallest name. A community's total degree comes from an aggregate, never from its members in one task."""
    sums = labels.join(level.nodes, "node").groupBy("label").agg(F.sum("k").alias("s"))
    asked = near.select(F.col("to").alias("label")).unionAll(labels.select("label")).groupBy("label").agg(F.count("*").alias("_rows"))
    known = asked.join(sums, "label")
    own = join_counted(labels.join(level.nodes.select("node", "k"), "node"), known, ["label"], total=level.n_links).drop("_rows")
    stay = near.where("label = to").select("node", F.col("w").alias("w_own"))
    share = resolution / (2 * level.m)
    own = own.join(stay, "node", "left").select("node", "k", (F.coalesce("w_own", F.lit(0.0)) - share * F.col("k") * (F.col("s") - F.col("k"))).alias("out"))
    there = join_counted(near.where("label <> to"), known.withColumnRenamed("label", "to"), ["to"], total=level.n_links).join(own, "node")
    gain = F.round((F.col("w") - share * F.col("k") * F.col("s") - F.col("out")) / level.m, 12)
    moves = there.select("node", "label", "to", gain.alias("gain")).where("gain > 0")
    # the best move by gain, then by the smallest name: names can't be negated, so it takes two steps
    top = moves.groupBy("node", "label").agg(F.max("gain").alias("gain"))
    return moves.join(top, ["node", "label", "gain"]).groupBy("node", "label", "gain").agg(F.min("to").alias("to")).select("node", "label", "to", "gain")


def _apart(moves: DataFrame, round_: int) -> DataFrame:
    """Moves of which no two leave or enter the same community: their gains add up exactly. A move is taken if it is the
    best of both its communities, so the best of all always is."""
    touched = moves.select(F.explode(F.array("label", "to")).alias("community"), F.struct("gain", F.xxhash64("node", F.lit(round_)).alias("h"), "node", "to").alias("move"))
    winners = touched.groupBy("community").agg(F.max("move").alias("move"))
    return winners.groupBy("move.node", "move.to").agg(F.count("*").alias("n"), F.max("move.gain").alias("gain")).where("n = 2").select("node", "to", "gain")


def _local_moves(level: _Level, labels: DataFrame, resolution: float, rounds: int) -> tuple[DataFrame, list[float]]:
    """Rounds of moves from ``labels`` until no single one helps, and the objective before and after each."""
    near, now = level.placed(labels, resolution)
    history, share = [now], 1.0
    for round_ in range(rounds):
        moves = persisted(_gains(near, labels, level, resolution))
        apart = _apart(moves, round_)
        row = moves.agg(F.count("*").alias("n")).crossJoin(apart.agg(F.sum("gain").alias("sure"))).first()
        if not row["n"]:
            break
        tried = None
        if share > 1e-4 and row["n"] > 1:
            # Moves go down in name and up by turns, so that two nodes don't trade places.
            way = F.col("to") < F.col("label") if round_ % 2 == 0 else F.col("to") > F.col("label")
            some = moves.where(way & (F.pmod(F.xxhash64("node", F.lit(-round_ - 1)), F.lit(10_000)) < share * 10_000))
            named = _moved(labels, some)
            found = level.placed(named, resolution)
            if found[1] > now and found[1] >= now + row["sure"]:
                tried = (named, *found)
            share = min(1.0, share * 2) if tried else share / 4
        if tried is None:
            named = _moved(labels, apart)
            tried = (named, *level.placed(named, resolution))
        labels, near, now = tried
        history.append(now)
    return labels, history


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return persisted(labels.join(moves.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label")))


def _coarser(level: _Level, labels: DataFrame, resolution: float) -> _Level:
    """Communities as nodes: links between two of them added up, links inside one kept as weight inside the node."""
    near, _ = level.placed(labels, resolution)
    links = near.where("label <> to").groupBy(F.col("label").alias("a"), F.col("to").alias("b")).agg(F.sum("w").alias("weight"))
    inner = level.inner + (near.where("label = to").agg(F.sum("w")).first()[0] or 0.0)
    nodes = labels.join(level.nodes, "node").groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k"))
    return _level(links, nodes, inner, level.m)


def louvain(links: DataFrame, resolution: float = 1.0, rounds: int = 60, total: str = "weight", levels: int = 20) -> tuple[DataFrame, list[float]]:
    """``node``, ``community`` by local moving on modularity, and the modularity after each round, which never falls.

    Each round every node names its best move. A share of all moves, picked by hash, is tried at once and kept if
    modularity rises at least as much as by the moves that can't disturb each other (no two touch the same community),
    which are taken otherwise; the share doubles when it was kept and is cut to a quarter when not. When no single move
    raises modularity, communities become the nodes of a smaller graph and move as a whole; then single nodes move again,
    until neither helps. ``levels=1`` stops after the first local optimum. Communities are named by their smallest member.
    With ``total="count"`` the number of links stands for their total weight, as some programs have it.
    """
    bottom = _bottom(links, total)
    labels = bottom.nodes.select("node", F.col("node").alias("label"))
    if not bottom.m:
        return labels.withColumnRenamed("label", "community"), []
    labels, history = _local_moves(bottom, labels, resolution, rounds)
    for _ in range(levels - 1):
        level = _coarser(bottom, labels, resolution)
        names, more = _local_moves(level, level.nodes.select("node", F.col("node").alias("label")), resolution, rounds)
        if len(more) == 1:
            break
        sizes = persisted(labels.groupBy("label").agg(F.count("*").alias("_rows")).join(names.toDF("label", "to"), "label"))
        labels = persisted(join_counted(labels, sizes, ["label"]).select("node", F.col("to").alias("label")))
        labels, again = _local_moves(bottom, labels, resolution, rounds)
        history += more[1:] + again[1:]
    least = persisted(labels.groupBy("label").agg(F.min("node").alias("community"), F.count("*").alias("_rows")))
    return join_counted(labels, least, ["label"]).select("node", "community"), history


def summaries(links: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """``community``, ``summary``: its members and its heaviest ``most`` relations."""
    inside = links.join(members.select(F.col("node").alias("a"), "community"), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("community = cb")
    best = top_k(inside.withColumn("pair", F.concat_ws(" - ", "a", "b")), most, "community", "pair", "weight")
    text = best.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", "pair"))).alias("p"))
    names = members.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    return names.join(text, "community", "left").select("community", F.concat(F.array_join("nodes", ", "), F.lit(": "), F.coalesce(F.array_join("p.pair", "; "), F.lit(""))).alias("summary"))


def neighbours(links: DataFrame, names: list[str]) -> DataFrame:
    """``name``, ``neighbour``, ``weight`` of the named nodes."""
    both = links.select(F.col("a").alias("name"), F.col("b").alias("neighbour"), "weight").unionAll(links.select(F.col("b").alias("name"), F.col("a").alias("neighbour"), "weight"))
    return both.where(F.col("name").isin(names))


def graph_stats(links: DataFrame) -> DataFrame:
    nodes = links.select("a").unionAll(links.select(F.col("b").alias("a"))).agg(F.countDistinct("a").alias("n_nodes"))
    return links.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("total_weight")).crossJoin(F.broadcast(nodes))


def analogy(vectors: DataFrame, a: int, b: int, c: int, k: int = 5) -> DataFrame:
    """The ``k`` vectors nearest by cosine to a - b + c, apart from the three."""
    pick = lambda i, n: vectors.where(F.col("vec_id") == i).select(F.col("embedding").alias(n)).limit(1)
    asked = pick(a, "va").crossJoin(pick(b, "vb")).crossJoin(pick(c, "vc"))
    target = F.zip_with(F.zip_with("va", "vb", lambda x, y: x - y), "vc", lambda x, y: x + y)
    rows = vectors.where(~F.col("vec_id").isin(a, b, c)).join(F.broadcast(asked.select(target.alias("q"))))
    return top_k(rows.select(F.lit(1).alias("query_id"), F.col("vec_id").alias("doc_id"), F.round(cosine(F.col("q"), F.col("embedding")), 9).alias("score")), k)


def global_query(summary: DataFrame, question: str) -> DataFrame:
    """The community summaries that share a word with the question; all of them if none does."""
    from quern.functions.text import words

    asked = sorted({w for w in question.lower().split()})
    cleaned = F.regexp_replace("summary", r"[^\p{L}\p{N}\s]", " ")
    marked = summary.withColumn("hit", F.arrays_overlap(words(cleaned), F.lit(asked)) if asked else F.lit(False))
    any_hit = marked.agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("any"))
    return marked.crossJoin(F.broadcast(any_hit)).where(F.col("hit") | ~F.col("any")).select("community", "summary")
