"""Memory graph: deduplication, upserts, local graphs and statistics over node and edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import first_seen


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order for each key, by partial aggregation."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *(F.col(f"_r.{c}").alias(c) for c in (*order, *rest)))


def build_edges(mentions: DataFrame, multi_relation: bool = False, weight_by_strength: bool = False) -> DataFrame:
    """One edge for each (src, dst), or (src, dst, relation): its last mention wins. Incomplete mentions are left out."""
    whole = mentions.filter("src <> '' AND dst <> '' AND relation <> ''")
    edges = last_wins(whole, ["src", "dst", "relation"] if multi_relation else ["src", "dst"], ["ordinal", "session_id"])
    return edges.withColumn("weight", F.col("strength") / 10.0 if weight_by_strength else F.lit(1.0))


def build_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, entity_type, chunk_id, degree): ends of edges, with the attributes of their last mention."""
    ends = node_degree(edges).withColumnRenamed("node", "name")
    attributes = last_wins(entities.filter("name <> ''").select("name", "ordinal", "entity_type", "chunk_id"), ["name"], ["ordinal"])
    return ends.join(attributes, "name", "left").select("name", "entity_type", "chunk_id", "degree")


def node_degree(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(node, degree): in- and out-edges; a loop counts twice."""
    by = by or []
    return edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, relations, mean degree."""
    nodes = node_degree(edges).agg(F.count(F.lit(1)).alias("nodes"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("relation").alias("relations")).crossJoin(nodes).withColumn("avg_degree", F.round(2 * F.col("edges") / F.col("nodes"), 6))


def dedup_exact(entities: DataFrame) -> DataFrame:
    """(entity_type, key, name, ordinal, mentions): entities of one lower-case name and type; the first names them."""
    rows = entities.select(F.lower("entity_type").alias("entity_type"), F.lower("name").alias("key"), "name", "ordinal")
    counts = rows.groupBy("entity_type", "key").agg(F.count(F.lit(1)).alias("mentions"))
    return first_seen(rows, ["entity_type", "key"], "ordinal").join(counts, ["entity_type", "key"])


def dedup_greedy(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(entity_type, name, canonical, ordinal): each entity joins the first representative of its type that it resembles.

    Equal lower-case names are merged first, so a type's distinct names, not its mentions, meet in one task; candidates
    come from an inverted index of words. The comparison is in order of first appearance and is not transitive.
    """
    distinct = dedup_exact(entities)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows, sets, by_word, names = rows.sort_values(["ordinal", "key"]), [], {}, []
        canonical = []
        for key, name in zip(rows["key"], rows["name"], strict=True):
            own = frozenset(key.split())
            near = sorted({i for w in own for i in by_word.get(w, ())})
            found = next((i for i in near if len(own & sets[i]) >= threshold * len(own | sets[i])), None)
            if found is None:
                for w in own:
                    by_word.setdefault(w, []).append(len(sets))
                sets.append(own)
                names.append(name)
            canonical.append(name if found is None else names[found])
        return rows.assign(canonical=canonical)[["entity_type", "key", "canonical", "ordinal"]]

    return distinct.groupBy("entity_type").applyInPandas(merge, "entity_type string, key string, canonical string, ordinal bigint")


def dedup_untyped(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(name, canonical, ordinal) of lower-case names: the same rule over the names of all types together."""
    merged = dedup_greedy(entities.select("ordinal", "name", F.lit("").alias("entity_type")), threshold)
    return merged.select(F.col("key").alias("name"), "canonical", "ordinal")


def canonicalize(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Ends replaced by their canonical names of (name, canonical); others stay."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(names.select(F.col("name").alias(end), F.col("canonical").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out.select(*edges.columns)


def _relation_key(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.lower(c).alias(f"{c}_key") for c in ("src", "relation", "dst")), "*")


def dedup_relationships(rows: DataFrame) -> DataFrame:
    """The first of the relations that are equal apart from case."""
    keyed = _relation_key(rows)
    return first_seen(keyed, ["src_key", "relation_key", "dst_key"], "ordinal").select(*rows.columns)


def merge_relationships(rows: DataFrame) -> DataFrame:
    """Relations equal apart from case as one: its first form, greatest strength, all sessions and chunks, mentions."""
    keyed = _relation_key(rows)
    return keyed.groupBy("src_key", "relation_key", "dst_key").agg(
        F.min("ordinal").alias("ordinal"), F.max("strength").alias("strength"), F.array_sort(F.collect_set("session_id")).alias("session_ids"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.count(F.lit(1)).alias("mentions"))


def edge_state(mentions: DataFrame) -> DataFrame:
    """Edges as upserts keep them: first relation, newest ids and time, greatest strength, all chunks, sessions and times."""
    newest = F.struct("ordinal", "session_id", "session_time", "chunk_id")
    rows = mentions.groupBy("src", "dst").agg(
        F.min(F.struct("ordinal", "relation")).alias("f"), F.max(newest).alias("n"), F.max("strength").alias("strength"),
        F.collect_set("chunk_id").alias("chunk_ids"), F.collect_set("session_id").alias("session_ids"), F.collect_set("session_time").alias("session_times"))
    lists = [F.array_sort(c).alias(c) for c in ("chunk_ids", "session_ids", "session_times")]
    return rows.select("src", "dst", F.col("f.relation").alias("relation"), "n.session_id", "n.session_time", "n.chunk_id", F.col("strength").cast("int").alias("strength"), (F.col("strength") / 10.0).alias("weight"), *lists)


def upsert_edges(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges of ``base`` merged with those of ``delta``, both as edge_state makes them."""
    b, d = base.alias("b"), delta.alias("d")
    joined = b.join(d, ["src", "dst"], "full")
    union = [F.array_sort(F.array_union(F.coalesce(f"b.{c}", F.array().cast(base.schema[c].dataType)), F.coalesce(f"d.{c}", F.array().cast(base.schema[c].dataType)))).alias(c) for c in ("chunk_ids", "session_ids", "session_times")]
    strength = F.greatest("b.strength", "d.strength")
    return joined.select("src", "dst", F.coalesce("b.relation", "d.relation").alias("relation"), *(F.coalesce(f"d.{c}", f"b.{c}").alias(c) for c in ("session_id", "session_time", "chunk_id")), strength.alias("strength"), (strength / 10.0).alias("weight"), *union)


def upsert_nodes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Nodes (name, entity_type, description, chunk_id): empty attributes are filled, the chunk is the newest."""
    joined = base.alias("b").join(delta.alias("d"), "name", "full")
    kept = [F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"d.{c}")).alias(c) for c in ("entity_type", "description")]
    return joined.select("name", *kept, F.coalesce("d.chunk_id", "b.chunk_id").alias("chunk_id"))


def typed_triples(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the type of each end's first mention, ``unknown`` without one."""
    types = first_seen(entities.select("name", "entity_type", "ordinal"), ["name"], "ordinal").select("name", "entity_type")
    out = edges
    for end in ("src", "dst"):
        out = out.join(types.select(F.col("name").alias(end), F.col("entity_type").alias(f"{end}_type")), end, "left").fillna("unknown", [f"{end}_type"])
    return out


def session_edges(edges: DataFrame, edge_mentions: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, edge.., matched): edges that a selected session of (query_id, session_id) mentions, with how many do."""
    hit = edge_mentions.join(selected.select("query_id", "session_id"), "session_id").groupBy("query_id", "src", "dst").agg(F.count(F.lit(1)).alias("matched"))
    return hit.join(edges, ["src", "dst"])


def session_node(session_id: Column | str) -> Column:
    return F.concat(F.lit("sess:"), F.col(session_id) if isinstance(session_id, str) else session_id)


def context_edges(edges: DataFrame, edge_mentions: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, src, dst): selected sessions to and from the ends of the edges they mention."""
    hit = edge_mentions.join(selected.select("query_id", "session_id"), "session_id").join(edges.select("src", "dst"), ["src", "dst"])
    pairs = hit.select("query_id", session_node("session_id").alias("s"), F.explode(F.array("src", "dst")).alias("e")).distinct()
    return pairs.select("query_id", F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("e").alias("dst")), F.struct(F.col("e").alias("src"), F.col("s").alias("dst")))).alias("x")).select("query_id", "x.src", "x.dst")


def synonym_edges(nodes: DataFrame, similar: DataFrame) -> DataFrame:
    """(query_id, src, dst, score), both ways, of nodes (query_id, node, vec) whose vectors are in ``similar(a, b, score)``.

    ``similar`` holds a pair of vectors once, with a = b for one vector that several nodes share; with ``query_id``, a
    question's own pairs.
    """
    left, right = nodes.select("query_id", F.col("node").alias("x"), F.col("vec").alias("a")), nodes.select("query_id", F.col("node").alias("y"), F.col("vec").alias("b"))
    pairs = left.join(similar, ["query_id", "a"] if "query_id" in similar.columns else "a").join(right, ["query_id", "b"]).filter("a <> b OR x < y")
    return pairs.select("query_id", "score", F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("p")).select("query_id", "p.src", "p.dst", "score").distinct()


def local_graph(relations: DataFrame, contexts: DataFrame, synonyms: DataFrame, relation_weight: float = 1.0, context_weight: float = 0.5, synonym_factor: float = 2.0) -> DataFrame:
    """(query_id, src, dst, edge_type, weight): of edges between two nodes a relation goes before a context before a synonym."""
    rows = relations.select("query_id", "src", "dst", F.lit(0).alias("o"), F.lit("relation").alias("edge_type"), F.lit(relation_weight).alias("weight"))
    rows = rows.unionByName(contexts.select("query_id", "src", "dst", F.lit(1).alias("o"), F.lit("context").alias("edge_type"), F.lit(context_weight).alias("weight")))
    rows = rows.unionByName(synonyms.select("query_id", "src", "dst", F.lit(2).alias("o"), F.lit("synonym").alias("edge_type"), (F.col("score") * synonym_factor).alias("weight")))
    return rows.groupBy("query_id", "src", "dst").agg(F.min(F.struct("o", "edge_type", "weight")).alias("e")).select("query_id", "src", "dst", "e.edge_type", "e.weight")


def local_multigraph(mentions: DataFrame, selected: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, src, dst, edge_type, relation, weight): relations weighted by mentions in selected sessions, synonyms by similarity."""
    hit = mentions.join(selected.select("query_id", "session_id"), "session_id").groupBy("query_id", "src", "dst", "relation").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = hit.select("query_id", "src", "dst", F.lit("relation").alias("edge_type"), "relation", "weight")
    return rows.unionByName(synonyms.select("query_id", "src", "dst", F.lit("synonymy").alias("edge_type"), F.lit("synonym").alias("relation"), F.col("score").alias("weight")))


def session_latest(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, session, latest): the greatest time of relations that leave an entity next to the session."""
    near = graph.filter("edge_type = 'context' AND src LIKE 'sess:%'").select("query_id", F.col("src").alias("session"), F.col("dst").alias("entity"))
    timed = edges.select("query_id", F.col("src").alias("entity"), "session_time")
    return near.join(timed, ["query_id", "entity"]).groupBy("query_id", "session").agg(F.max("session_time").alias("latest"))


def entity_relationships(wanted: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(entity, place, src, relation, dst): the first k edges of each entity, those to it before those from it, each once."""
    into = edges.join(wanted.select("entity"), edges["dst"] == F.col("entity")).select("entity", F.lit(0).alias("side"), "ordinal", "src", "relation", "dst")
    out = edges.join(wanted.select("entity"), edges["src"] == F.col("entity")).select("entity", F.lit(1).alias("side"), "ordinal", "src", "relation", "dst")
    once = into.unionByName(out).groupBy("entity", "src", "relation", "dst").agg(F.min(F.struct("side", "ordinal")).alias("o"))
    window = Window.partitionBy("entity").orderBy("o", "src", "dst")
    return once.withColumn("place", F.row_number().over(window).cast("bigint")).filter(F.col("place") <= k).select("entity", "place", "src", "relation", "dst")
