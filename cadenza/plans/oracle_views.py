"""The canonical views in DuckDB SQL."""

DISTANCE = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) ** 2))"
#: The number, from 1, of the vector in cs that is nearest to v.
NEAREST = f"list_min(list_transform(range(1, len(cs) + 1), lambda j: ({DISTANCE.replace('c[', 'cs[j][')}, j)))[2]"
VIEWS = {
    "plays": """SELECT event_id, (3000000 + user_id * 10 + floor((day(ts) - 1) / 3))::BIGINT AS session_int_id, user_id AS user_int_id,
      (props->>'$.k')::BIGINT AS track_id, CASE WHEN event_type <> 'signup' THEN least(value / 100, 1.0) END AS playratio,
      CASE event_type WHEN 'error' THEN 'skip' WHEN 'purchase' THEN 'complete' ELSE 'playback_start' END AS event_type,
      ts AS created_at, ts + to_minutes((props->>'$.k')::BIGINT) AS updated_at FROM events""",
    "st": """SELECT l_orderkey AS session_id, o_custkey AS user_id, l_partkey AS track_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position, l_discount * 10 AS playratio,
      CASE WHEN l_discount * 10 > 0.8 THEN 'positive' WHEN l_discount * 10 > 0.2 THEN 'neutral' ELSE 'skip' END AS label
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pt": """SELECT l_orderkey AS playlist_id, l_linenumber AS position, l_partkey AS track_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem""",
    "us": "SELECT 'user_' || c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 100000 ELSE c_custkey END AS user_int_id FROM customer",
    "loved": """SELECT o_custkey AS user_id, l_partkey AS track_id, max(l_shipdate) AS loved_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1, 2""",
    "cat": """SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist, p_type AS album, p_size AS duration_sec, p_size <> 13 AS is_playable,
      CASE WHEN p_size = 26 THEN 'quarantined' ELSE 'available' END AS availability_status, CASE WHEN p_size = 26 THEN 'fixture' END AS quarantine_reason,
      CASE WHEN p_size <> 39 THEN 'nav_' || p_partkey END AS nav_id FROM part""",
    "playable": "SELECT * FROM cat WHERE is_playable AND availability_status = 'available' AND nav_id IS NOT NULL AND quarantine_reason IS NULL",
    "emb": "SELECT vec_id AS track_id, embedding FROM embeddings",
    "rm": """SELECT o_orderkey AS metric_id, o_custkey AS user_id, 'm' || (o_orderkey % 3) AS model_version,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'catalog_insufficient' WHEN '2-HIGH' THEN 'model_degraded' ELSE 'healthy' END AS fallback_state,
      o_orderstatus = 'P' AND o_orderkey % 5 = 0 AS pipeline_error, o_totalprice / 100 AS total_latency_ms, o_orderkey % 19 AS returned_count,
      o_orderdate AS created_at FROM orders""",
    "split": """SELECT session_id, CASE WHEN r < floor(n * 0.75) THEN 'train' WHEN r < floor(n * 0.75) + floor(n * 0.125) THEN 'val' ELSE 'test' END AS part
      FROM (SELECT session_id, row_number() OVER (ORDER BY md5(session_id::VARCHAR), session_id) - 1 AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT o_orderkey AS session_id FROM orders))""",
    "pop": "SELECT track_id, count(*) AS track_count, ln(1 + count(*)) AS pop_score FROM st GROUP BY 1",
    "edges": """SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT track_id AS src, lead(track_id) OVER (PARTITION BY session_id ORDER BY position) AS dst
      FROM st WHERE label IN ('positive', 'neutral') AND session_id IN (SELECT session_id FROM split WHERE part = 'train'))
      WHERE dst IS NOT NULL AND src IN (SELECT track_id FROM cat) AND dst IN (SELECT track_id FROM cat) GROUP BY 1, 2""",
    "pl_once": """SELECT a.track_id AS a, b.track_id AS b, sum(1.0::DOUBLE / (b.position - a.position)) AS w FROM pt a JOIN pt b
      ON a.playlist_id = b.playlist_id AND b.place - a.place BETWEEN 1 AND 5 AND b.position - a.position BETWEEN 1 AND 5 GROUP BY 1, 2""",
    "pl_edges": "SELECT src, dst, sum(w) AS weight FROM (SELECT a AS src, b AS dst, w FROM pl_once UNION ALL SELECT b, a, w FROM pl_once) GROUP BY 1, 2",
    "neighbours": "SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM edges WHERE src <> dst) WHERE rank <= 3",
    "positives": "SELECT user_id, track_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_id DESC, position DESC) AS rank FROM st WHERE label = 'positive') WHERE rank <= 300",
    "taste": """SELECT user_id, track_id, sum(c)::BIGINT AS copies FROM (SELECT user_id, track_id, 3 AS c FROM loved UNION ALL SELECT user_id, track_id, 1 FROM positives)
      WHERE track_id IN (SELECT track_id FROM emb) GROUP BY 1, 2""",
    "ctx": """SELECT session_id, user_id, t, last, anchor, CASE anchor_label WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.5 ELSE 0.0 END::DOUBLE AS y,
      CASE anchor_label WHEN 'neutral' THEN 0.3 ELSE 1.0 END::DOUBLE AS weight, n FROM (SELECT session_id, user_id, row_number() OVER w - 1 AS t, track_id AS last, lead(track_id) OVER w AS anchor,
      lead(label) OVER w AS anchor_label, count(*) OVER (PARTITION BY session_id) AS n FROM st WINDOW w AS (PARTITION BY session_id ORDER BY position)) WHERE anchor_label <> 'unknown'""",
    "hard": """SELECT session_id, t, candidate, rank FROM (SELECT session_id, t, dst AS candidate, row_number() OVER (PARTITION BY session_id, t ORDER BY e.weight DESC, dst) AS rank
      FROM ctx JOIN edges e ON src = last WHERE dst <> anchor AND n >= 3 AND t <= n - 3) WHERE rank <= 3""",
    "scored": """SELECT c.session_id || ':' || c.t AS context, x.candidate, x.candidate = c.anchor AS is_positive,
      CASE WHEN x.candidate = c.anchor THEN c.y ELSE 0.0 END AS y, CASE WHEN x.candidate = c.anchor THEN c.weight ELSE 1.0 END AS weight,
      ('0x' || substr(md5(c.session_id || ':' || c.t || ':' || x.candidate), 1, 13))::BIGINT / (2.0::DOUBLE ** 52) * 4 - 2 AS score
      FROM ctx c JOIN (SELECT session_id, t, anchor AS candidate FROM ctx UNION SELECT session_id, t, candidate FROM hard) x
      ON x.session_id = c.session_id AND x.t = c.t WHERE c.n >= 3 AND c.t <= c.n - 3""",
    "recent": "SELECT session_id, track_id, position FROM st",
    "both_edges": "SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM edges UNION ALL SELECT src, dst, weight FROM pl_edges) GROUP BY 1, 2",
    "cooc": """SELECT session_id, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, track_id) AS r FROM (
      SELECT session_id, dst AS track_id, round(sum(exp(-0.3 * age) * weight), 6) AS score FROM (SELECT session_id, track_id AS src, row_number() OVER (PARTITION BY session_id ORDER BY position DESC) - 1 AS age FROM recent)
      JOIN both_edges USING (src) WHERE age < 10 GROUP BY 1, 2)) WHERE r <= 100""",
    "points": """SELECT user_id, track_id, copies, embedding::DOUBLE[] AS v, CASE WHEN n < 6 THEN 1 WHEN n <= 12 THEN 2 ELSE 3 END AS k
      FROM (SELECT *, sum(copies) OVER (PARTITION BY user_id) AS n FROM taste JOIN emb USING (track_id)) WHERE n >= 2""",
    "seed_1": "SELECT user_id, [arg_min(v, (md5(track_id::VARCHAR), track_id))] AS cs FROM points WHERE k > 1 GROUP BY 1",
    "seed_2": f"""SELECT s.user_id, CASE WHEN max(d) > 0 THEN list_append(any_value(cs), arg_max(v, (d, -track_id))) ELSE any_value(cs) END AS cs
      FROM (SELECT *, list_min(list_transform(cs, lambda c: {DISTANCE})) AS d FROM points JOIN seed_1 USING (user_id)) s GROUP BY 1""",
    "seed_3": f"""SELECT s.user_id, CASE WHEN any_value(k) > 2 AND max(d) > 0 THEN list_append(any_value(cs), arg_max(v, (d, -track_id))) ELSE any_value(cs) END AS cs
      FROM (SELECT *, list_min(list_transform(cs, lambda c: {DISTANCE})) AS d FROM points JOIN seed_2 USING (user_id)) s GROUP BY 1""",
    "lloyd": f"""SELECT 0 AS step, user_id, cs FROM seed_3 UNION ALL
      SELECT step + 1, user_id, list_transform(range(1, len(any_value(cs)) + 1), lambda j: coalesce(map_extract(map_from_entries(list((i, m))), j)[1], any_value(cs)[j])) AS cs
      FROM (SELECT step, user_id, i, any_value(cs) AS cs, list_transform(range(1, len(any_value(v)) + 1), lambda x: list_sum(list_transform(list((v, copies)), lambda p: p[1][x] * p[2])) / sum(copies)) AS m
        FROM (SELECT step, p.user_id, cs, v, copies, {NEAREST} AS i FROM lloyd JOIN points p USING (user_id) WHERE step < 20) GROUP BY step, user_id, i) GROUP BY step, user_id""",
    "kmeans": f"""SELECT user_id, i - 1 AS centroid_idx, any_value(cs)[i] AS centroid, sum(copies)::BIGINT AS cluster_size
      FROM (SELECT p.user_id, cs, copies, {NEAREST} AS i FROM lloyd JOIN points p USING (user_id) WHERE step = 20) GROUP BY user_id, i
      UNION ALL SELECT user_id, 0, list(s / n ORDER BY dim), any_value(n)::BIGINT FROM (SELECT user_id, dim, sum(x * copies) AS s, sum(copies) AS n
        FROM (SELECT user_id, copies, unnest(v) AS x, unnest(range(len(v))) AS dim FROM points WHERE k = 1) GROUP BY 1, 2) GROUP BY 1""",
    "pref_k": """SELECT user_id, centroid_idx, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, centroid_idx ORDER BY score DESC, track_id) AS r FROM (
      SELECT user_id, centroid_idx, k, track_id, round(list_dot_product(embedding::DOUBLE[], centroid), 6) AS score
      FROM (SELECT *, greatest(1, floor(80 * cluster_size / sum(cluster_size) OVER (PARTITION BY user_id))) AS k FROM kmeans), emb)) WHERE r <= k""",
    "pref": """SELECT user_id, track_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, track_id) AS r FROM (
      SELECT user_id, track_id, max(score) AS score FROM pref_k GROUP BY 1, 2)) WHERE r <= 80""",
    "found": """SELECT session_id, track_id, max(score) AS score, count(*) AS n_branches FROM (SELECT session_id, track_id, score FROM cooc
      UNION ALL SELECT session_id, track_id, score FROM (SELECT DISTINCT session_id, user_id FROM st) JOIN pref USING (user_id)) GROUP BY 1, 2""",
    "head": "SELECT track_id, pop_score FROM pop ORDER BY pop_score DESC, track_id LIMIT 250",
    "filled": """SELECT session_id, track_id, score FROM (SELECT s.session_id, h.track_id, h.pop_score AS score, s.n, row_number() OVER (PARTITION BY s.session_id ORDER BY h.pop_score DESC, h.track_id) AS r
      FROM (SELECT session_id, count(track_id) AS n FROM (SELECT DISTINCT session_id FROM recent) LEFT JOIN found USING (session_id) GROUP BY 1) s, head h
      ANTI JOIN found f ON f.session_id = s.session_id AND f.track_id = h.track_id) WHERE r <= greatest(20, 50 - n)""",
    "merged": "SELECT session_id, track_id, score, n_branches FROM found UNION ALL SELECT session_id, track_id, score, 1 FROM filled",
    "ranked": """SELECT m.session_id, m.track_id, p.artist, m.score AS ranker_score FROM merged m JOIN playable p USING (track_id)""",
    "excluded": "SELECT DISTINCT session_id, track_id FROM recent",
    "penal": """SELECT session_id, track_id, artist, ranker_score, spared, ranker_score - CASE WHEN spared THEN 0 ELSE 0.18::DOUBLE END * (row_number() OVER (PARTITION BY session_id, artist ORDER BY ranker_score DESC, track_id) - 1) AS policy_score
      FROM (SELECT r.*, e.track_id IS NOT NULL AS gone, bool_and(e.track_id IS NOT NULL) OVER (PARTITION BY r.session_id) AS spared
      FROM ranked r LEFT JOIN excluded e ON e.session_id = r.session_id AND e.track_id = r.track_id) WHERE NOT gone OR spared""",
    "queue": """SELECT session_id, track_id, policy_score, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY again, policy_score DESC, track_id) AS place FROM (
      SELECT *, NOT spared AND row_number() OVER (PARTITION BY session_id, lower(trim(artist)) ORDER BY policy_score DESC, track_id) > 1 AS again FROM penal)) WHERE place <= 18""",
    "delta": """SELECT session_int_id AS session_id, user_int_id AS user_id, position, track_id, playratio,
      CASE WHEN playratio > 0.8 THEN 'positive' WHEN playratio > 0.2 THEN 'neutral' ELSE 'skip' END AS label
      FROM (SELECT *, row_number() OVER (PARTITION BY session_int_id ORDER BY created_at, event_id) - 1 AS position FROM plays WHERE playratio IS NOT NULL)
      WHERE created_at > TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20'""",
    "roll": """SELECT model_version, count(*) AS request_count, CASE WHEN count(*) = 0 THEN 0 ELSE round(sum(pipeline_error::INT) / count(*), 6) END AS error_rate,
      round(sum((fallback_state <> 'healthy')::INT) / count(*), 6) AS fallback_rate, sum((fallback_state = 'catalog_insufficient')::INT)::BIGINT AS catalog_failure_count,
      avg(returned_count) AS avg_returned_count,
      list_sort(list(total_latency_ms))[round_even(0.5::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p50_latency_ms,
      list_sort(list(total_latency_ms))[round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT + 1] AS p95_latency_ms,
      CASE WHEN count(*) >= 20 THEN 'ok' ELSE 'insufficient' END AS sample_status FROM rm GROUP BY 1""",
    "batch": """SELECT track_id, CASE WHEN track_id % 7 = 0 THEN 'nav_' || (track_id + 7) WHEN track_id % 7 = 1 THEN 'nav_' || (track_id + 1) ELSE 'new_' || track_id END AS nav_id
      FROM cat WHERE track_id % 7 IN (0, 1, 3)""",
}
NEEDS = {
    "playable": ["cat"], "pop": ["st"], "edges": ["st", "split", "cat"], "pl_once": ["pt"], "pl_edges": ["pl_once"], "neighbours": ["edges"], "positives": ["st"],
    "taste": ["loved", "positives", "emb"], "ctx": ["st"], "hard": ["ctx", "edges"], "scored": ["ctx", "hard"], "recent": ["st"], "both_edges": ["edges", "pl_edges"], "cooc": ["recent", "both_edges"],
    "points": ["taste", "emb"], "seed_1": ["points"], "seed_2": ["seed_1"], "seed_3": ["seed_2"], "lloyd": ["seed_3"], "kmeans": ["lloyd"], "pref_k": ["kmeans", "emb"], "pref": ["pref_k"], "found": ["cooc", "pref", "st"], "head": ["pop"], "filled": ["recent", "found", "head"], "merged": ["found", "filled"], "ranked": ["merged", "playable"], "excluded": ["recent"], "penal": ["ranked", "excluded"], "queue": ["penal"], "delta": ["plays"],
    "roll": ["rm"], "batch": ["cat"],
}


#: Views that are read several times and cost much.
OFTEN = {"points", "seed_3", "kmeans", "edges", "pl_edges", "found", "merged", "penal", "queue", "taste", "pref", "cooc"}


def sql(views: str, body: str) -> str:
    """`body` after the named views and all that they need."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in chosen:
            chosen.append(name)

    for name in views.split():
        add(name)
    kind = lambda name: "MATERIALIZED " if name in OFTEN else ""
    return ("WITH RECURSIVE " if "lloyd" in chosen else "WITH ") + ",\n".join(f"{name} AS {kind(name)}({VIEWS[name]})" for name in chosen) + f"\n{body}"
