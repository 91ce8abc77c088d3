"""Queries of the memory graph: building, deduplication, upserts, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query
from .operators import graph as G


def _entities(t):
    return t["entities"]


@query("SELECT src, relation, dst, session_id, session_time, chunk_id, ordinal FROM edges")
def build_edges(t):
    return G.build_edges(t["mentions"]).select("src", "relation", "dst", "session_id", "session_time", "chunk_id", "ordinal")


@query("""SELECT d.name, a.entity_type, a.chunk_id, d.degree FROM (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) GROUP BY name) d
    LEFT JOIN (SELECT name, entity_type, chunk_id, row_number() OVER (PARTITION BY name ORDER BY ordinal DESC, entity_type DESC, chunk_id DESC) AS rn FROM entities) a ON a.name = d.name AND rn = 1""")
def build_nodes(t):
    return G.build_nodes(_entities(t), G.build_edges(t["mentions"]))


@query("SELECT edges, relations, nodes, round(2 * edges / nodes, 6) AS avg_degree FROM (SELECT count(*) AS edges, count(DISTINCT relation) AS relations FROM edges), (SELECT count(*) AS nodes FROM (SELECT src FROM edges UNION SELECT dst FROM edges))")
def graph_stats(t):
    return G.graph_stats(t["edges"])


@query("SELECT entity_type, count(*) AS nodes FROM types GROUP BY entity_type")
def node_type_counts(t):
    return G.build_nodes(_entities(t), t["edges"]).groupBy("entity_type").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT relation, count(*) AS edges FROM edges GROUP BY relation")
def edge_type_counts(t):
    return t["edges"].groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def node_degree(t):
    return G.node_degree(t["edges"])


@query("SELECT e.src, e.relation, e.dst, coalesce(a.entity_type, 'unknown') AS src_type, coalesce(b.entity_type, 'unknown') AS dst_type FROM edges e LEFT JOIN types a ON a.name = e.src LEFT JOIN types b ON b.name = e.dst")
def typed_triples(t):
    return G.typed_triples(t["edges"].select("src", "relation", "dst"), _entities(t)).select("src", "relation", "dst", "src_type", "dst_type")


@query("SELECT lower(entity_type) AS entity_type, lower(name) AS key, min(ordinal) AS ordinal, arg_min(name, ordinal) AS name, count(*) AS mentions FROM parts GROUP BY lower(entity_type), lower(name)")
def dedup_entities_exact(t):
    return G.dedup_exact(t["parts"]).select("entity_type", "key", "ordinal", "name", "mentions")


_LIKE = "len(list_intersect(string_split(lower(x), ' '), string_split(r.key, ' '))) >= 0.3 * len(list_distinct(list_concat(string_split(lower(x), ' '), string_split(r.key, ' '))))"


@query(f"""WITH RECURSIVE firsts AS (SELECT lower(entity_type) AS entity_type, lower(name) AS key, min(ordinal) AS ordinal, arg_min(name, ordinal) AS name FROM parts GROUP BY 1, 2),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY ordinal, key) AS rn FROM firsts),
    walk AS (SELECT entity_type, key, ordinal, name AS canonical, [name] AS reps, rn FROM ordered WHERE rn = 1
        UNION ALL SELECT entity_type, key, ordinal, coalesce(f, name), CASE WHEN f IS NULL THEN list_append(reps, name) ELSE reps END, rn FROM (SELECT r.*, w.reps, list_filter(w.reps, lambda x: {_LIKE})[1] AS f FROM walk w JOIN ordered r ON r.entity_type = w.entity_type AND r.rn = w.rn + 1))
    SELECT entity_type, key, canonical, ordinal FROM walk""")
def dedup_entities_greedy(t):
    return G.dedup_greedy(t["parts"], 0.3)


@query(f"""WITH RECURSIVE firsts AS (SELECT '' AS entity_type, lower(name) AS key, min(ordinal) AS ordinal, arg_min(name, ordinal) AS name FROM parts GROUP BY 1, 2),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY ordinal, key) AS rn FROM firsts),
    walk AS (SELECT entity_type, key, ordinal, name AS canonical, [name] AS reps, rn FROM ordered WHERE rn = 1
        UNION ALL SELECT entity_type, key, ordinal, coalesce(f, name), CASE WHEN f IS NULL THEN list_append(reps, name) ELSE reps END, rn FROM (SELECT r.*, w.reps, list_filter(w.reps, lambda x: {_LIKE})[1] AS f FROM walk w JOIN ordered r ON r.entity_type = w.entity_type AND r.rn = w.rn + 1))
    SELECT key AS name, canonical, ordinal FROM walk""")
def dedup_entities_untyped(t):
    return G.dedup_untyped(t["parts"], 0.3)


_ALIAS = "CASE WHEN starts_with({0}, 'Part#') THEN concat('Part~', substr({0}, 6, 2)) ELSE {0} END"


def _aliases(t):
    return t.sql("SELECT DISTINCT dst AS name, concat('Part~', substr(dst, 6, 2)) AS canonical FROM mentions WHERE dst LIKE 'Part#%'")


@query(f"SELECT ordinal, {_ALIAS.format('src')} AS src, relation, {_ALIAS.format('dst')} AS dst FROM edges")
def canonicalize_edges(t):
    return G.canonicalize(t["edges"].select("ordinal", "src", "relation", "dst"), _aliases(t))


_CANON = f"SELECT ordinal, {_ALIAS.format('src')} AS src, CASE WHEN ordinal % 2 = 0 THEN upper(relation) ELSE relation END AS relation, {_ALIAS.format('dst')} AS dst, session_id, chunk_id, strength FROM mentions"


def _canonical(t):
    rows = t["mentions"].withColumn("relation", F.when(F.col("ordinal") % 2 == 0, F.upper("relation")).otherwise(F.col("relation")))
    return G.canonicalize(rows.select("ordinal", "src", "relation", "dst", "session_id", "chunk_id", "strength"), _aliases(t))


@query(f"SELECT lower(src) AS s, lower(relation) AS r, lower(dst) AS d, min(ordinal) AS ordinal FROM ({_CANON}) GROUP BY 1, 2, 3")
def dedup_relationships(t):
    return G.dedup_relationships(_canonical(t)).select(F.lower("src").alias("s"), F.lower("relation").alias("r"), F.lower("dst").alias("d"), "ordinal")


@query(f"SELECT lower(src) AS src_key, lower(relation) AS relation_key, lower(dst) AS dst_key, min(ordinal) AS ordinal, max(strength) AS strength, array_to_string(list_sort(list(DISTINCT session_id)), ',') AS session_ids, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunk_ids, count(*) AS mentions FROM ({_CANON}) GROUP BY 1, 2, 3")
def merge_relationships(t):
    rows = G.merge_relationships(_canonical(t))
    return rows.withColumn("session_ids", F.array_join("session_ids", ",")).withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ","))


_STATE = """SELECT src, dst, arg_min(relation, (ordinal, relation)) AS relation, arg_max(session_id, (ordinal, session_id)) AS session_id, arg_max(session_time, (ordinal, session_id)) AS session_time, arg_max(chunk_id, (ordinal, session_id)) AS chunk_id, max(strength) AS strength,
    list(DISTINCT chunk_id) AS c, list(DISTINCT session_id) AS s, list(DISTINCT session_time) AS t FROM mentions WHERE chunk_id % 2 {} 0 GROUP BY src, dst"""


@query(f"""SELECT coalesce(b.src, d.src) AS src, coalesce(b.dst, d.dst) AS dst, coalesce(b.relation, d.relation) AS relation, coalesce(d.session_id, b.session_id) AS session_id, coalesce(d.session_time, b.session_time) AS session_time, coalesce(d.chunk_id, b.chunk_id) AS chunk_id,
    greatest(b.strength, d.strength) AS strength, greatest(b.strength, d.strength) / 10.0::double AS weight, array_to_string(list_sort(list_distinct(list_concat(b.c, d.c))), ',') AS chunk_ids, array_to_string(list_sort(list_distinct(list_concat(b.s, d.s))), ',') AS session_ids, array_to_string(list_sort(list_distinct(list_concat(b.t, d.t))), ',') AS session_times
    FROM ({_STATE.format('=')}) b FULL JOIN ({_STATE.format('<>')}) d ON b.src = d.src AND b.dst = d.dst""")
def incremental_upsert(t):
    base, delta = (G.edge_state(t["mentions"].filter(f"chunk_id % 2 {sign} 0")) for sign in ("=", "<>"))
    rows = G.upsert_edges(base, delta)
    return rows.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",")).withColumn("session_ids", F.array_join("session_ids", ",")).withColumn("session_times", F.array_join("session_times", ","))


@query()
def incremental_stream(t):
    from .streaming.memory import replay

    return replay(t["mentions"])


@query("SELECT src, dst, array_to_string(list_sort(list_distinct(list_concat(list(session_id), [max(own)]))), ',') AS sessions FROM (SELECT m.src, m.dst, m.session_id, e.session_id AS own FROM edge_mentions m JOIN edges e ON e.src = m.src AND e.dst = m.dst) GROUP BY src, dst")
def edge_sessions(t):
    from .functions.text import session_union

    lists = t["edge_mentions"].groupBy("src", "dst").agg(F.collect_list("session_id").alias("session_ids"))
    rows = lists.join(t["edges"].select("src", "dst", "session_id"), ["src", "dst"])
    return rows.select("src", "dst", F.array_join(F.array_sort(session_union("session_ids", "session_id")), ",").alias("sessions"))


@query("""SELECT entity, place, src, relation, dst FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY side, ordinal, src, dst) AS place FROM (
    SELECT entity, src, relation, dst, arg_min(side, (side, ordinal)) AS side, arg_min(ordinal, (side, ordinal)) AS ordinal FROM (SELECT w.entity, 0 AS side, e.ordinal, e.src, e.relation, e.dst FROM edges e JOIN (SELECT n_name AS entity FROM nation) w ON e.dst = w.entity UNION ALL SELECT w.entity, 1, e.ordinal, e.src, e.relation, e.dst FROM edges e JOIN (SELECT n_name AS entity FROM nation) w ON e.src = w.entity) GROUP BY entity, src, relation, dst)) WHERE place <= 10""")
def entity_relationships(t):
    return G.entity_relationships(t["nation"].select(F.col("n_name").alias("entity")), t["edges"], 10)


@query("SELECT term, node, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, node) AS rank FROM (SELECT term, node, CASE WHEN lower(node) = lower(term) THEN 1.0::double ELSE 0.8::double END AS score FROM (SELECT lower(n_name) AS term FROM nation UNION ALL SELECT concat('customer#', cast(n_nationkey AS string)) FROM nation) t JOIN (SELECT DISTINCT name AS node FROM entities) n ON contains(lower(node), lower(term)) OR contains(lower(term), lower(node)))) WHERE rank <= 5")
def fuzzy_entities(t):
    from .operators.retrieval import fuzzy_entities as fuzzy

    terms = t["nation"].select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit("customer#"), F.col("n_nationkey").cast("string")))).alias("term"))
    return fuzzy(terms, _entities(t).select(F.col("name").alias("node")).distinct())


@query("SELECT src, relation, dst, concat(src, ' ', relation, ' ', dst) AS text, concat(src, ' - ', relation, ' - ', dst, ': chunk ', cast(chunk_id AS string)) AS embedding_text FROM edges")
def triple_text(t):
    from .functions.text import triple_embedding_text
    from .functions.text import triple_text as text

    return t["edges"].select("src", "relation", "dst", text("src", "relation", "dst").alias("text"), triple_embedding_text("src", "relation", "dst", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))).alias("embedding_text"))


_NODES = "SELECT name, arg_max(entity_type, ordinal) AS entity_type, arg_max(chunk_id, ordinal) AS chunk_id FROM entities WHERE chunk_id % 2 {} 0 GROUP BY name"


@query(f"SELECT coalesce(b.name, d.name) AS name, coalesce(b.entity_type, d.entity_type) AS entity_type, coalesce(d.chunk_id, b.chunk_id) AS chunk_id FROM ({_NODES.format('=')}) b FULL JOIN ({_NODES.format('<>')}) d ON b.name = d.name")
def incremental_nodes(t):
    base, delta = (t["entities"].filter(f"chunk_id % 2 {sign} 0").groupBy("name").agg(F.max_by("entity_type", "ordinal").alias("entity_type"), F.lit("").alias("description"), F.max_by("chunk_id", "ordinal").alias("chunk_id")) for sign in ("=", "<>"))
    return G.upsert_nodes(base, delta).select("name", "entity_type", "chunk_id")
