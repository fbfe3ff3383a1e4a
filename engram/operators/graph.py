"""Causal graphs: chains by id and by text, paths in both directions, narratives, what a changed fact caused.

Frontiers are joined with the edges round by round and cut after each, so a round's plan doesn't hold the rounds before.
A path holds its own nodes, so cycles end; a round keeps whole what it found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.retrieval import text_similarity, words_over
from engram.session import BROADCAST_ROWS, bounded_join, cut, salted_join

#: Links of one effect that a task joins with the walks to it; more are dealt over several.
PIECE = 200


def change_causes(facts: DataFrame, predicates: tuple[str, ...] = ("prefers", "uses", "works_at")) -> DataFrame:
    """(old_id, new_id) of retracted facts and the active one of the same agent, subject and predicate that states another
    object: of several the last confirmed, then the smallest id, so a change has one successor instead of all pairs."""
    key, kept = ["agent_id", "subject", "predicate"], facts.where(F.col("predicate").isin(*predicates) & F.col("object").isNotNull())
    now = kept.where("is_active").groupBy(*key, "object").agg(F.min(F.struct((-F.unix_micros("last_confirmed")).alias("t"), "id")).alias("x"))
    # The first and the best of another object: two candidates a group are enough.
    two = now.groupBy(*key).agg(F.slice(F.array_sort(F.collect_set(F.struct(F.col("x.t").alias("t"), F.col("x.id").alias("id"), "object"))), 1, 2).alias("c"))
    met = salted_join(kept.where("not is_active").select("id", *key, "object"), two, key, "inner")
    other = F.element_at(F.filter("c", lambda c: c["object"] != F.col("object")), 1)
    return met.where(F.exists("c", lambda c: c["object"] != F.col("object"))).select(F.col("id").alias("old_id"), other["id"].alias("new_id"))


def paths(links: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.3) -> DataFrame:
    """(path, score) from seeds (node) along links (cause_id, effect_id, confidence) in both directions, of one to ``hops`` edges.

    The score is the product of the confidences; a path never meets a node twice.
    """
    good = links.where((F.col("confidence") >= least) & F.col("cause_id").isNotNull() & F.col("effect_id").isNotNull() & (F.col("cause_id") != F.col("effect_id")))
    both = good.select(F.col("cause_id").alias("a"), F.col("effect_id").alias("b"), "confidence").unionByName(good.select(F.col("effect_id").alias("a"), F.col("cause_id").alias("b"), "confidence"))
    edges = cut(both.groupBy("a", "b").agg(F.max("confidence").alias("confidence")))
    front = seeds.select(F.col("node").alias("a"), F.array("node").alias("path"), F.lit(1.0).alias("score")).distinct()
    out = None
    for _ in range(hops):
        step = salted_join(front, edges, ["a"], "inner").where(~F.array_contains("path", F.col("b")))
        front = cut(step.select(F.col("b").alias("a"), F.concat("path", F.array("b")).alias("path"), (F.col("score") * F.col("confidence")).alias("score")))
        out = front if out is None else out.unionByName(front)
    return out.select("path", "score")


def narrative(found: DataFrame, names: DataFrame, most: int = 2000) -> DataFrame:
    """(path, story) of paths: names (node, name) joined by arrows, at most ``most`` characters of a story."""
    steps = found.select("path", F.posexplode("path").alias("i", "node"))
    named = steps.join(names.groupBy("node").agg(F.min("name").alias("name")), "node", "left")
    told = named.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "node").alias("n")))), lambda x: x["n"]), " -> ").alias("story"))
    return told.select("path", F.when(F.length("story") > most, F.concat(F.substring("story", 1, most - 3), F.lit("..."))).otherwise(F.col("story")).alias("story"))


def chain_by_id(links: DataFrame, is_root: Column, rounds: int = 4) -> DataFrame:
    """(root, id, depth) of the links behind each root: itself at depth 1, then those whose effect_id is the cause_id of one met before.

    A link is met once at each depth, by however many ways, so cycles end with the rounds. Null ids of causes and effects lead
    nowhere. Rounds walk distinct nodes from distinct starts, and only nodes that are an effect; links and roots are met at the end.
    """
    own = Window.partitionBy("id")
    kinds = links.groupBy("id", "cause_id", "effect_id").agg(F.max(F.coalesce(is_root, F.lit(False))).alias("is_root"))
    held = cut(kinds.withColumn("again", F.count("*").over(own) > 1))
    ends = held.where("effect_id is not null").select(F.col("effect_id").alias("node"), "id", "again")
    live = cut(ends.groupBy("node").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")))
    ends = bounded_join(ends, live, ["node"], "inner").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    edges = cut(bounded_join(held.select(F.col("effect_id").alias("a"), F.col("cause_id").alias("node")).where("a is not null").distinct(), live, ["node"], "inner"))
    roots = cut(bounded_join(held.where("is_root").select(F.col("id").alias("root"), F.col("cause_id").alias("node"), "again").distinct(), live, ["node"], "inner"))
    front = roots.select(F.col("node").alias("start"), "node", "pieces").distinct()
    walks = None
    for depth in range(2, rounds + 1):
        if depth > 2:
            front = salted_join(front.select("start", F.col("node").alias("a")), edges, ["a"], "inner").select("start", "node", "pieces").distinct()
        front = cut(front)
        if front.isEmpty():
            break
        step = front.select("start", "node", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(depth).alias("depth"))
        walks = step if walks is None else walks.unionByName(step)
    out = held.where("is_root").select(F.col("id").alias("root"), "id", F.lit(1).alias("depth")).distinct()
    if walks is None:
        return out
    starts = roots.select("root", F.col("node").alias("start"), "again")
    # A number of its own, as small pieces that grow in the join would be put together again.
    spark = links.sparkSession
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    walks = walks.repartition(many, "node", "piece")

    def met(to: DataFrame, by: DataFrame) -> DataFrame:
        ways = by.drop("again").repartition(many, "node", "piece").join(walks, ["node", "piece"])
        return bounded_join(ways, to.drop("again"), ["start"], "inner", limit=10 * BROADCAST_ROWS).select("root", "id", "depth")

    # Of ids that stand for one link each, no row comes twice; only others are made distinct.
    out = out.unionByName(met(starts.where("not again"), ends.where("not again")))
    if held.where("again").isEmpty():
        return out
    return out.unionByName(met(starts.where("again"), ends).unionByName(met(starts.where("not again"), ends.where("again"))).distinct())


def chain_by_text(links: DataFrame, target: str, least: float = 0.15, rounds: int = 5, near: float = 0.85) -> DataFrame:
    """(root, id, depth, total) of causal chains that explain a target text.

    Links whose effect is like the target start; in each round a link's cause text leads to the links whose effect is it
    (likeness of ``near`` or more, found among those that share a rare word). ``total`` is the product of the confidences.
    A link is met once, at its least depth, by its best total.
    """
    held = cut(links.where("cause is not null and effect is not null").select("id", "cause", "effect", "confidence"))
    seeds = held.where(text_similarity(F.col("effect"), F.lit(target)) >= least)
    front = seeds.select(F.col("id").alias("root"), "id", "cause", F.lit(1).alias("depth"), F.coalesce("confidence", F.lit(0.0)).alias("total"))
    texts = held.select("effect").distinct()
    causes = held.select("cause").distinct()
    # Texts meet once each by a word of more than four letters; links follow the few pairs of like texts.
    long_words = lambda c: F.explode(words_over(F.col(c), 4))
    pairs = causes.select("cause", long_words("cause").alias("w")).join(texts.select("effect", long_words("effect").alias("w")), "w").select("cause", "effect").distinct()
    alike = cut(pairs.where(text_similarity(F.col("cause"), F.col("effect")) >= near))
    met = front = cut(front)
    for depth in range(2, rounds + 1):
        step = front.join(alike, "cause").join(held.select(F.col("id").alias("to"), F.col("cause").alias("next"), "effect", F.coalesce("confidence", F.lit(0.0)).alias("c")), "effect")
        fresh = step.join(met.select("root", F.col("id").alias("to")), ["root", "to"], "left_anti").groupBy("root", "to", "next").agg(F.max(F.col("total") * F.col("c")).alias("total"))
        front = cut(fresh.select("root", F.col("to").alias("id"), F.col("next").alias("cause"), F.lit(depth).alias("depth"), "total"))
        if front.isEmpty():
            break
        met = met.unionByName(front)
    return met.select("root", "id", "depth", "total")


def entity_gate(facts: DataFrame, person: str, asked: list[str], least: int = 20) -> DataFrame:
    """(person, n, other, m, blocked): whether a question's distinctive words belong to another person.

    Persons are subjects of ``least`` facts or more. ``n`` counts the asked words in the facts of the person, ``m`` the
    greatest count of another; blocked where n is 0 and m is not, or m is above three times n.
    """
    words = F.array(*[F.lit(w.lower()) for w in asked])
    rows = facts.where("subject is not null").select(F.lower("subject").alias("s"), F.size(F.filter(words, lambda w: F.lower(F.concat_ws(" ", "predicate", "object")).contains(w))).alias("h"))
    sums = rows.groupBy("s").agg(F.count("*").alias("k"), F.sum("h").alias("h")).where(F.col("k") >= least)
    own = sums.where(F.col("s") == person.lower()).agg(F.coalesce(F.sum("h"), F.lit(0)).alias("n"))
    other = sums.where(F.col("s") != person.lower()).agg(F.max(F.struct("h", F.col("s").alias("s"))).alias("x"))
    both = own.join(F.broadcast(other))  # one row each
    m = F.coalesce(F.col("x.h"), F.lit(0))
    return both.select(F.lit(person).alias("person"), "n", F.col("x.s").alias("other"), m.alias("m"), (((F.col("n") == 0) & (m > 0)) | (m > 3 * F.col("n"))).alias("blocked"))
