"""The views that the catalogue's queries run on: one SQL text for Spark and for the engine they are compared with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_DATE = "replace(cast(cast(o_orderdate AS date) AS string), '-', '/')"

VIEWS = {
    # conversations as sessions of turns
    "turns": "SELECT conv_id AS doc_id, concat('S', cast(conv_id AS string)) AS session_id, concat('2024/01/', lpad(cast(conv_id % 30 + 1 AS string), 2, '0')) AS session_time, turn, role AS speaker, text AS content FROM conversations",
    # relation mentions of the trade tables, one session for each customer and one for each nation
    "mentions": f"""SELECT ordinal, src, relation, dst, session_id, session_time, chunk_id, cast(1 + chunk_id % 10 AS int) AS strength FROM (
        SELECT o_orderkey * 64 AS ordinal, concat('Customer#', cast(o_custkey AS string)) AS src, 'placed' AS relation, concat('Order#', cast(o_orderkey AS string)) AS dst, concat('S', cast(o_custkey AS string)) AS session_id, {_DATE} AS session_time, o_orderkey AS chunk_id FROM orders
        UNION ALL SELECT o_orderkey * 64 + 1 + 2 * l_linenumber, concat('Order#', cast(o_orderkey AS string)), 'contains', concat('Part#', cast(l_partkey AS string)), concat('S', cast(o_custkey AS string)), {_DATE}, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT o_orderkey * 64 + 2 + 2 * l_linenumber, concat('Part#', cast(l_partkey AS string)), 'supplied by', concat('Supplier#', cast(l_suppkey AS string)), concat('S', cast(o_custkey AS string)), {_DATE}, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 1000000000000 + s_suppkey, concat('Supplier#', cast(s_suppkey AS string)), 'located in', n_name, concat('N', cast(n_nationkey AS string)), '1995/01/01', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 2000000000000 + n_nationkey, n_name, 'part of', r_name, concat('N', cast(n_nationkey AS string)), '1995/01/01', cast(n_nationkey AS bigint) FROM nation JOIN region ON n_regionkey = r_regionkey) m""",
    # entity mentions: every end of a relation mention with its type
    "entities": """SELECT ordinal, name, entity_type, session_id, chunk_id FROM (
        SELECT ordinal * 2 AS ordinal, src AS name, session_id, chunk_id, CASE WHEN contains(src, '#') THEN lower(split_part(src, '#', 1)) ELSE 'place' END AS entity_type FROM mentions
        UNION ALL SELECT ordinal * 2 + 1, dst, session_id, chunk_id, CASE WHEN contains(dst, '#') THEN lower(split_part(dst, '#', 1)) ELSE 'place' END FROM mentions) e""",
    # one edge for each pair of nodes: the last mention wins
    "edges": """SELECT ordinal, src, relation, dst, session_id, session_time, chunk_id, strength, ordinal % (SELECT count(*) FROM embeddings) AS vec FROM (
        SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ordinal DESC, session_id DESC) AS rn FROM mentions) m WHERE rn = 1""",
    # the sessions that mention an edge
    "edge_mentions": "SELECT DISTINCT src, dst, session_id FROM mentions",
    # cosine similarity of every hundredth vector, the questions, with all
    "sessions": "SELECT session_id, max(session_time) AS session_time, cast(substr(session_id, 2) AS bigint) % (SELECT count(*) FROM embeddings) AS vec FROM mentions GROUP BY session_id",
    "parts": "SELECT p_partkey AS ordinal, p_name AS name, p_brand AS entity_type FROM part",
    "session_docs": "SELECT doc_id, session_id, session_time, concat(upper(speaker), ' ', content) AS context, turn FROM turns",
    "dates": "SELECT o_orderkey AS id, replace(cast(cast(o_orderdate AS date) AS string), '-', '/') AS a, cast(cast(o_orderdate AS date) AS string) AS b, cast(o_orderdate AS string) AS stamp FROM orders",
    # answers that reach each way of matching and its failure
    "answers": """SELECT event_id AS id, event_type AS question_type, concat('event ', event_type, ' of user ', cast(user_id AS string)) AS question,
        CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN cast(user_id AS string) WHEN 2 THEN concat(event_type, ', user!') WHEN 3 THEN concat('user ', event_type) WHEN 4 THEN 'café crème' ELSE concat(cast(user_id AS string), ' days') END AS expected,
        CASE WHEN event_id % 7 = 0 THEN 'nothing known' WHEN event_id % 6 = 4 THEN 'It was CAFÉ  crème.' ELSE concat('The ', upper(event_type), ' user is ', cast(user_id AS string), ' after ', cast(event_id % 50 AS string), ' days') END AS output,
        concat('S', cast(event_id % 20 AS string), ', S', cast(user_id % 20 AS string), ';') AS origin, concat('S', cast(event_id % 5 AS string)) AS top_a, concat('S', cast(user_id % 20 AS string)) AS top_b FROM events""",
    "usage": """SELECT conv_id * 16 + turn AS id, CASE role WHEN 'user' THEN 'query' WHEN 'assistant' THEN 'answer' ELSE 'summary' END AS stage, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unlisted' END AS model,
        CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) END AS prompt_tokens, CASE WHEN turn % 4 = 3 THEN 0 ELSE turn * 10 END AS completion_tokens FROM conversations""",
}


#: Further views that only the other engine needs: what the operators compute in between.
STEPS = {
    "cos": "SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS score FROM embeddings q, (SELECT * FROM embeddings) v WHERE q.vec_id % 100 = 0",
    "pairs": "SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS score FROM embeddings a JOIN (SELECT * FROM embeddings) b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4",
    "scored": "SELECT c.query_id, e.*, c.score FROM edges e JOIN cos c ON e.vec = c.id",
    "toptriples": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal, src, dst) AS rank FROM scored) WHERE rank <= 20",
    "channela": "SELECT c.query_id, s.session_id, c.score FROM sessions s JOIN cos c ON s.vec = c.id",
    "channelb": "SELECT query_id, session_id, max(score) AS score, count(*) AS triples FROM toptriples GROUP BY query_id, session_id HAVING max(score) > 0",
    "fused": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion, 9) DESC, session_id) AS rank FROM (
        SELECT *, 0.5::double * a_norm + 0.5::double * b_raw AS fusion FROM (SELECT *, CASE WHEN max(a_raw) OVER (PARTITION BY query_id) - min(a_raw) OVER (PARTITION BY query_id) < 1e-9 THEN 1.0::double ELSE (a_raw - min(a_raw) OVER (PARTITION BY query_id)) / (max(a_raw) OVER (PARTITION BY query_id) - min(a_raw) OVER (PARTITION BY query_id)) END AS a_norm FROM (
        SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.score, 0.0) AS a_raw, coalesce(b.score, 0.0) AS b_raw, CASE WHEN coalesce(a.r <= 15, false) AND b.score IS NOT NULL THEN 'AB' WHEN coalesce(a.r <= 15, false) THEN 'A' ELSE 'B' END AS source
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS r FROM channela) a FULL JOIN channelb b ON a.query_id = b.query_id AND a.session_id = b.session_id WHERE coalesce(a.r <= 15, false) OR b.score IS NOT NULL))) QUALIFY rank <= 15""",
    "chosen": "SELECT f.query_id, e.src, e.dst, count(*) AS matched FROM edge_mentions e JOIN fused f ON e.session_id = f.session_id GROUP BY f.query_id, e.src, e.dst",
    "relations": "SELECT c.query_id, c.matched, e.* FROM chosen c JOIN edges e ON c.src = e.src AND c.dst = e.dst",
    "touched": "SELECT DISTINCT f.query_id, concat('sess:', f.session_id) AS s, CASE WHEN k = 0 THEN e.src ELSE e.dst END AS e FROM edge_mentions e JOIN fused f ON e.session_id = f.session_id CROSS JOIN (VALUES (0), (1)) v(k)",
    "contexts": "SELECT query_id, s AS src, e AS dst FROM touched UNION ALL SELECT query_id, e, s FROM touched",
    "localnodes": "SELECT query_id, node, min(ordinal) AS ordinal, max(CASE WHEN contains(node, '#') THEN cast(split_part(node, '#', 2) AS bigint) % (SELECT count(*) FROM embeddings) END) AS vec FROM (SELECT query_id, src AS node, ordinal * 2 AS ordinal FROM relations UNION ALL SELECT query_id, dst, ordinal * 2 + 1 FROM relations) GROUP BY query_id, node",
    "halfsynonyms": "SELECT x.query_id, x.node AS src, y.node AS dst, p.score FROM localnodes x JOIN (SELECT a, b, score FROM pairs UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings) p ON x.vec = p.a JOIN localnodes y ON y.query_id = x.query_id AND y.vec = p.b WHERE p.a <> p.b OR x.node < y.node",
    "synonyms": "SELECT DISTINCT query_id, src, dst, score FROM (SELECT * FROM halfsynonyms UNION ALL SELECT query_id, dst, src, score FROM halfsynonyms)",
    "localgraph": """SELECT query_id, src, dst, edge_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id, src, dst ORDER BY o, weight) AS rn FROM (
        SELECT query_id, src, dst, 0 AS o, 'relation' AS edge_type, 1.0::double AS weight FROM relations UNION ALL SELECT query_id, src, dst, 1, 'context', 0.5 FROM contexts UNION ALL SELECT query_id, src, dst, 2, 'synonym', score * 2.0 FROM synonyms)) WHERE rn = 1""",
    "degrees": "SELECT query_id, node, count(*) AS degree FROM (SELECT query_id, src AS node FROM localgraph UNION ALL SELECT query_id, dst FROM localgraph) GROUP BY query_id, node",
    "latest": "SELECT c.query_id, c.src AS session, max(r.session_time) AS latest FROM localgraph c JOIN relations r ON r.query_id = c.query_id AND r.src = c.dst WHERE c.edge_type = 'context' AND starts_with(c.src, 'sess:') GROUP BY c.query_id, c.src",
    "named": "SELECT query_id, CASE rank WHEN 1 THEN lower(src) ELSE dst END AS entity FROM toptriples WHERE rank <= 2",
    "phrases": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM (SELECT query_id, node, greatest(max(score), 0.0) AS score FROM (SELECT query_id, score, src AS node FROM toptriples UNION ALL SELECT query_id, score, dst FROM toptriples) e SEMI JOIN localnodes USING (query_id, node) GROUP BY query_id, node)) WHERE rank <= 5",
    "anchors": "SELECT a.query_id, a.node, 0.2::double / greatest(d.degree, 1) AS score FROM (SELECT DISTINCT query_id, node FROM (SELECT n.query_id, n.entity, l.node, row_number() OVER (PARTITION BY n.query_id, n.entity ORDER BY CASE WHEN l.node = n.entity THEN 0 ELSE 1 END, l.ordinal, l.node) AS rn FROM (SELECT DISTINCT query_id, entity FROM named) n JOIN localnodes l ON l.query_id = n.query_id AND (contains(lower(l.node), lower(n.entity)) OR contains(lower(n.entity), lower(l.node)))) WHERE rn = 1) a JOIN degrees d ON d.query_id = a.query_id AND d.node = a.node",
    "aged": "SELECT f.query_id, concat('sess:', f.session_id) AS node, f.fusion, CASE WHEN l.latest IS NULL THEN 0.0 ELSE abs(datediff('day', strptime(l.latest, '%Y/%m/%d'), DATE '1998-05-02'))::double END AS gap FROM fused f LEFT JOIN latest l ON l.query_id = f.query_id AND l.session = concat('sess:', f.session_id)",
    "sessionseeds": "SELECT query_id, node, 0.5::double * fusion * exp(-pow(gap / greatest(median(gap) OVER (PARTITION BY query_id), 1.0), 0.2)) AS score FROM aged",
    "seeds": "SELECT query_id, node, score / sum(score) OVER (PARTITION BY query_id) AS mass FROM (SELECT query_id, node, max(score) AS score FROM (SELECT query_id, node, score FROM phrases UNION ALL SELECT query_id, node, score FROM anchors) GROUP BY query_id, node UNION ALL SELECT query_id, node, score FROM sessionseeds WHERE score > 0)",
    "moves": "SELECT g.query_id, g.src, g.dst, g.weight / o.total AS move FROM localgraph g JOIN (SELECT query_id, src, sum(weight) AS total FROM localgraph GROUP BY query_id, src) o ON o.query_id = g.query_id AND o.src = g.src",
    "allnodes": "SELECT query_id, node FROM degrees UNION SELECT query_id, node FROM seeds",
    "flows": "SELECT query_id, src, dst, move FROM moves UNION ALL SELECT a.query_id, a.node, s.node, s.mass FROM allnodes a JOIN seeds s ON s.query_id = a.query_id WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.query_id = a.query_id AND m.src = a.node) UNION ALL SELECT query_id, node, node, 0.0 FROM allnodes",
    "nodeseeds": "SELECT a.query_id, a.node, coalesce(s.mass, 0.0) AS mass FROM allnodes a LEFT JOIN seeds s ON s.query_id = a.query_id AND s.node = a.node",
    "steps": """SELECT a.query_id, a.node, 1.0::double / n AS p, 0 AS it FROM allnodes a JOIN (SELECT query_id, count(*) AS n FROM allnodes GROUP BY query_id) c ON c.query_id = a.query_id
        UNION ALL SELECT q, v, 0.8::double * flow + 0.2::double * mass, it FROM (SELECT r.query_id AS q, f.dst AS v, max(r.it) + 1 AS it, sum(r.p * f.move) AS flow, max(s.mass) AS mass FROM steps r JOIN flows f ON f.query_id = r.query_id AND f.src = r.node JOIN nodeseeds s ON s.query_id = f.query_id AND s.node = f.dst WHERE r.it < 10 GROUP BY r.query_id, f.dst)""",
    "ranks": "SELECT query_id, node, p AS score FROM steps WHERE it = 10",
    "bothends": "SELECT r.*, coalesce(a.score, 0.0) AS ppr_src, coalesce(b.score, 0.0) AS ppr_dst FROM relations r LEFT JOIN ranks a ON a.query_id = r.query_id AND a.node = r.src LEFT JOIN ranks b ON b.query_id = r.query_id AND b.node = r.dst",
    "types": "SELECT name, entity_type FROM (SELECT name, entity_type, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS rn FROM entities) WHERE rn = 1",
    "allentities": "SELECT DISTINCT name AS node, entity_type, CASE WHEN contains(name, '#') THEN cast(split_part(name, '#', 2) AS bigint) % (SELECT count(*) FROM embeddings) END AS vec FROM entities",
    "similarentities": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM (SELECT c.query_id, n.node, greatest(max(0.7::double * c.score + CASE WHEN n.entity_type = 'customer' THEN 0.3::double ELSE 0.0 END), 0.0) AS score FROM allentities n JOIN cos c ON n.vec = c.id GROUP BY c.query_id, n.node)) WHERE rank <= 10",
}


def names_in(sql: str) -> list[str]:
    """The tables and views that a SQL text reads."""
    found = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql))
    return [n for n in (*BASE, *VIEWS, *STEPS) if n in found]


class Tables:
    """Base tables and views of one folder, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.known = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in BASE else self.sql(VIEWS[name])
        return self.known[name]

    def sql(self, text: str) -> DataFrame:
        used = names_in(text)
        for name in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **{n: self[n] for n in used})


def with_views(sql: str) -> str:
    """A query for the other engine, its views as common table expressions."""
    views, needed, todo = VIEWS | STEPS, set(), names_in(sql)
    while todo:
        name = todo.pop()
        if name in views and name not in needed:
            needed.add(name)
            todo += names_in(views[name])
    ctes = [f"{n} AS {'' if n == 'steps' else 'MATERIALIZED '}({views[n]})" for n in views if n in needed]
    if not ctes:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ") or "steps" in needed
    if body.upper().startswith("WITH "):
        body = body[15 if body.upper().startswith("WITH RECURSIVE ") else 5 :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}, {body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}"
