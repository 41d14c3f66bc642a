"""Link weights and attention as keyed state over passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.plans.ordered import quantiles

#: Rates of adaptation and decay.
FRESH, REPLAY, ABSENT = 0.55, 0.18, 0.93
ATT_FRESH, ATT_REPLAY, ATT_MISSING = 0.72, 0.50, 0.78
NODE_RATE, NODE_UNSEEN, PROPAGATION = 0.58, 0.82, 0.34


def relation_target(support: Column | str = "support") -> Column:
    """The weight an edge is drawn to, from its relation, similarity, evidence, support and contradictions."""
    c = F.col
    sim = F.least(F.greatest(F.coalesce(c("similarity"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rel = F.upper("relation")
    base = F.when(rel == "SOURCE_LINEAGE", 0.62).when(rel == "SEMANTIC_SIMILARITY", 0.10 + 0.36 * sim).when(rel == "SHARED_ENTITY", 0.18).when(rel == "MENTIONS", 0.15).when(rel.contains("CONTRADICT") | rel.contains("DISCONFIRM"), 0.12).otherwise(F.greatest(F.lit(0.12), F.least(F.lit(0.45), F.coalesce(c("confidence"), F.lit(0.2)))))
    count = lambda n, most: F.least(F.greatest(F.coalesce(c(n), F.lit(0)), F.lit(0)), F.lit(most))
    ind = F.greatest(F.coalesce(c("independence_count"), F.lit(0)), F.lit(0))
    t = base + 0.07 * count("independence_count", 3) + 0.025 * count("evidence_count", 4) + 0.08 * F.coalesce(c(support) if isinstance(support, str) else support, F.lit(0.0)) - 0.12 * count("contradiction_count", 3)
    t = F.when((rel == "SOURCE_LINEAGE") & (ind == 0), F.least(t, F.lit(0.72))).when((rel == "SEMANTIC_SIMILARITY") & (ind == 0), F.least(t, F.lit(0.49))).otherwise(t)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), t))


def calibrate(edges: DataFrame, state: DataFrame, pass_id: str) -> DataFrame:
    """The next state of every edge, observed or not.

    edges: (edge_key, signature, target, confidence); state: (edge_key, weight,
    seen, misses). An edge with a new signature moves fast, a replayed one slowly;
    an absent one decays and after four misses under 0.08 is dormant. Seen
    signatures keep the 64 largest. Observing an edge clears its misses.
    """
    both = edges.alias("e").join(state.alias("s"), "edge_key", "fullouter")
    here = F.col("e.signature").isNotNull()
    none = F.array().cast("array<string>")
    seen = F.coalesce(F.col("s.seen"), none)
    old = F.when(here, F.coalesce(F.col("s.weight"), F.col("e.confidence"), F.lit(0.2))).otherwise(F.coalesce(F.col("s.weight"), F.lit(0.0)))
    fresh = here & ~F.array_contains(seen, F.col("e.signature"))
    new = F.when(here, old + F.when(fresh, FRESH).otherwise(REPLAY) * (F.col("e.target") - old)).otherwise(old * ABSENT)
    misses = F.when(here, 0).otherwise(F.coalesce(F.col("s.misses"), F.lit(0)) + 1)
    kept = F.when(here, F.reverse(F.slice(F.reverse(F.array_sort(F.array_union(seen, F.array("e.signature")))), 1, 64))).otherwise(seen)
    rows = both.select("edge_key", old.alias("old"), new.alias("new"), here.alias("observed"), F.coalesce(fresh, F.lit(False)).alias("fresh"), misses.cast("int").alias("misses"), kept.alias("seen"))
    d = F.col("new") - F.col("old")
    seen_move = F.when(d > 0.015, "STRENGTHENED").when(d < -0.015, "WEAKENED").otherwise("STABLE")
    gone_move = F.when((F.col("misses") >= 4) & (F.col("new") < 0.08), "DORMANT_CANDIDATE").when(F.col("new") < F.col("old"), "WEAKENED_NOT_REOBSERVED").otherwise("STABLE")
    return rows.select("edge_key", F.round("new", 6).alias("weight"), F.round("old", 6).alias("previous_weight"), F.round(d, 6).alias("delta"), F.when(F.col("observed"), seen_move).otherwise(gone_move).alias("movement"), "observed", "fresh", "misses", "seen", F.lit(pass_id).alias("pass_id"))


def edge_attention(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Attention of each edge of a pass: edges (edge_key, weight, observed, fresh, contradictions), state (edge_key, attention, streak, fresh_events, passes)."""
    c = F.col
    rows = edges.join(state, "edge_key", "left")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    fresh = c("fresh") & c("observed")
    streak = F.when(fresh, 0).otherwise(F.coalesce("streak", F.lit(0)) + c("observed").cast("int"))
    rows = rows.withColumn("_f", fresh).withColumn("_s", streak).withColumn("_old", F.coalesce("attention", "weight", F.lit(0.2)))
    burst = 0.18 * (1 - F.exp(-0.9 * F.least(c("_s"), F.lit(6))))
    fatigue = 0.58 * (1 - F.exp(-0.45 * F.greatest(c("_s") - 3, F.lit(0))))
    rows = rows.withColumn("_b", burst).withColumn("_t", fatigue)
    aim = clamp(clamp(F.coalesce("weight", F.lit(0.2))) + F.when(c("_f"), 0.14).otherwise(0.0) + c("_b") - c("_t") + F.least(F.lit(0.16), 0.05 * F.coalesce("contradictions", F.lit(0))))
    new = F.when(~c("observed"), clamp(c("_old") * ATT_MISSING)).otherwise(clamp(c("_old") + F.when(c("_f"), ATT_FRESH).otherwise(ATT_REPLAY) * (aim - c("_old"))))
    rows = rows.withColumn("_n", new)
    d = c("_n") - c("_old")
    move = F.when(c("observed") & (c("_s") >= 8) & (c("_t") > c("_b")) & (c("_n") < 0.22), "SATURATED_REPLAY_DECAY").when(d > 0.02, "ATTENTION_STRENGTHENED").when(d < -0.02, "ATTENTION_WEAKENED").otherwise("ATTENTION_STABLE")
    keep = [x for x in edges.columns if x != "fresh"]
    return rows.select(*keep, c("_f").alias("fresh"), F.round("_n", 6).alias("attention"), F.round(d, 6).alias("delta"), move.alias("movement"), c("_s").alias("streak"), (F.coalesce("fresh_events", F.lit(0)) + c("_f").cast("int")).alias("fresh_events"), (F.coalesce("passes", F.lit(0)) + c("observed").cast("int")).alias("passes"))


def node_signals(edges: DataFrame) -> DataFrame:
    """(node, local, degree): largest and mean of the three largest incident weights and novelty, damped for hubs."""
    ends = edges.select(F.col("source").alias("node"), "attention", "fresh", "observed").unionByName(edges.select(F.col("target").alias("node"), "attention", "fresh", "observed"))
    top = ends.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy(F.col("attention").desc())))
    g = top.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("attention").alias("most"), F.avg(F.when(F.col("_r") <= 3, F.col("attention"))).alias("mean3"), F.sum(F.col("fresh").cast("int")).alias("fresh"), F.sum(F.col("observed").cast("int")).alias("seen"))
    hub = 1 / (1 + 0.10 * F.log1p(F.greatest(F.col("degree") - 4, F.lit(0))))
    local = (0.55 * F.col("most") + 0.27 * F.col("mean3") + 0.18 * F.col("fresh") / F.greatest(F.lit(1), F.col("seen"))) * hub
    return g.select("node", F.greatest(F.lit(0.0), F.least(F.lit(1.0), local)).alias("local"), "degree")


def propagate(local: DataFrame, edges: DataFrame, rings: int = 3) -> DataFrame:
    """(node, local, signal): each ring mixes a node's own signal with its neighbours', by edge weight."""
    near = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.greatest(F.lit(0.01), F.col("attention")).alias("w"))
    near = near.unionByName(near.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
    base = local.select("node", "local")
    signal = base.select("node", F.col("local").alias("signal"))
    for _ in range(rings):
        came = near.join(signal.toDF("other", "s"), "other").groupBy("node").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias("came"))
        signal = base.join(came, "node", "left").select("node", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - PROPAGATION) * F.col("local") + PROPAGATION * F.coalesce("came", F.lit(0.0)))).alias("signal"))
    return base.join(signal, "node")


def focus(nodes: DataFrame, most: int = 5) -> DataFrame:
    """Ranks nodes (node, score) and marks the focus: scores of at least max(0.28, third quartile), most of them at most, one at least."""
    edge = quantiles(nodes, "score", {"quartile": 0.75}).select(F.greatest(F.lit(0.28), "quartile").alias("edge"))
    w = W.orderBy(F.col("score").desc(), "node")
    top = nodes.orderBy(F.col("score").desc(), "node").limit(max(most, 1)).withColumn("rank", F.row_number().over(w)).crossJoin(F.broadcast(edge)).filter((F.col("score") >= F.col("edge")) | (F.col("rank") == 1)).select("node", "rank")
    state = F.when(F.col("rank") == 1, "PRIMARY_FOCUS").when(F.col("rank").isNotNull(), "ACTIVE_FOCUS").when(F.col("score") < 0.10, "DORMANT").otherwise("PERIPHERY")
    return nodes.join(top, "node", "left").select("node", "score", "rank", state.alias("focus_state"))


def package_stats(edges: DataFrame, attention: DataFrame, focus: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row that counts a package: edges, attended edges and nodes, active centres, subjects and their mean coverage.

    focus: (node, focus_state); coverage: (subject, known, fields), a row for each
    facet. Without subjects the mean is 0.
    """
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    active = F.count_if(F.col("focus_state").isin("PRIMARY_FOCUS", "ACTIVE_FOCUS"))
    each = coverage.groupBy("subject").agg((F.sum("known") / F.sum("fields")).alias("share"))
    mean = each.agg(F.count(F.lit(1)).alias("subjects"), F.coalesce(F.round(F.avg("share"), 6), F.lit(0.0)).alias("mean_coverage"))
    nodes = focus.agg(F.count(F.lit(1)).alias("attention_nodes"), active.alias("active_focus_nodes"))
    return count(edges, "edges").crossJoin(count(attention, "attention_edges")).crossJoin(nodes).crossJoin(mean)
