"""Object decisions: stores, ranges, pulls, references, liveness, collection, loss, dependencies."""

from tidewright.operators.decision import decision

FUNCTIONS = decision(
    "function_conflicts",
    "functions",
    """
SELECT f.module, f.qualname, f.version, min(f.seq) AS first_seq, count(*) AS registrations, count(DISTINCT f.payload) > 1 AS conflict
FROM {functions} f GROUP BY f.module, f.qualname, f.version
""",
    "First write wins; other bytes under the same key conflict.",
)

OBJECTS = decision(
    "object_conflicts",
    "results objects",
    """
SELECT r.object, count(*) AS publications, CAST(sum(CASE WHEN r.attempt < o.attempt THEN 1 ELSE 0 END) AS BIGINT) AS stale,
       count(DISTINCT CASE WHEN r.attempt = o.attempt THEN r.payload END) > 1 AS conflict,
       count(DISTINCT CASE WHEN r.attempt = o.attempt THEN r.node END) AS replicas
FROM {results} r JOIN {objects} o ON o.object = r.object GROUP BY r.object
""",
    "Publications of a stale attempt are ignored; replicas of the current attempt must agree on everything but their node.",
)

RANGES = decision(
    "range_coverage",
    "chunks",
    """
WITH live AS (SELECT transfer, s, e FROM {chunks} WHERE e > s),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY transfer ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
         row_number() OVER (PARTITION BY transfer ORDER BY s, e) AS r FROM live),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY transfer ORDER BY r) AS island FROM marked)
SELECT transfer, min(s) AS s, max(e) AS e FROM islands GROUP BY transfer, island
""",
    "Union of touching half-open ranges; empty ones are ignored.",
)

COMPLETION = decision(
    "pull_completion",
    "chunks",
    """
WITH sized AS (SELECT transfer, max(e) AS size FROM {chunks} GROUP BY transfer),
live AS (SELECT transfer, s, e, payload FROM {chunks} WHERE e > s),
marked AS (
  SELECT *, coalesce(max(e) OVER (PARTITION BY transfer ORDER BY s, e, payload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM live),
gaps AS (SELECT transfer, CAST(sum(greatest(s - reach, 0)) AS BIGINT) AS missing, bool_or(s < reach) AS overlap FROM marked GROUP BY transfer),
clash AS (SELECT DISTINCT a.transfer FROM live a JOIN live b ON a.transfer = b.transfer AND a.s < b.e AND b.s < a.e AND a.payload <> b.payload)
SELECT z.transfer, z.size, coalesce(g.missing, z.size) AS missing, coalesce(g.missing, z.size) = 0 AS complete, coalesce(g.overlap, FALSE) AS overlap, c.transfer IS NOT NULL AS conflict
FROM sized z LEFT JOIN gaps g ON g.transfer = z.transfer LEFT JOIN clash c ON c.transfer = z.transfer
""",
    "A pull is complete when its chunks leave no gap; overlapping chunks must carry the same bytes.",
)

PULL = decision(
    "pull_decision",
    "pull_state locations",
    """
WITH source AS (
  SELECT p.object, min(CASE WHEN NOT l.excluded AND l.node <> p.requester THEN l.node END) AS node
  FROM {pull_state} p LEFT JOIN {locations} l ON l.object = p.object GROUP BY p.object)
SELECT p.object,
       CASE WHEN p.local_ready THEN 'LOCAL_READY' WHEN p.failed THEN 'FAILED' WHEN p.active_transfer IS NOT NULL THEN 'JOIN_PULL'
            WHEN s.node IS NULL THEN 'WAIT_FOR_LOCATION' ELSE 'START_PULL' END AS action,
       CASE WHEN NOT p.local_ready AND NOT p.failed AND p.active_transfer IS NULL THEN s.node END AS source
FROM {pull_state} p JOIN source s ON s.object = p.object
""",
    "Pull action by precedence; the source is the smallest node that isn't the requester or excluded.",
)

CHUNK_PLAN = decision(
    "chunk_plan",
    "objects settings",
    """
SELECT object, explode(sequence(CAST(0 AS BIGINT), size * 4096 - 1, chunk_bytes)) AS chunk_offset, size * 4096 AS size
FROM {objects} CROSS JOIN {settings} WHERE size > 0
""",
    "Offsets of the chunks that move an object.",
    check="SELECT object, unnest(generate_series(0, size * 4096 - 1, chunk_bytes)) AS chunk_offset, size * 4096 AS size FROM {objects} CROSS JOIN {settings} WHERE size > 0",
)

DELETABLE = decision(
    "store_deletable",
    "objects replicas object_refs",
    """
SELECT r.node, r.object, o.size FROM {replicas} r JOIN {objects} o ON o.object = r.object
WHERE NOT EXISTS (SELECT 1 FROM {object_refs} p WHERE p.object = r.object AND p.worker = r.node AND p.kind = 3)
""",
    "Replicas that no transfer pins on their node.",
)

DROP = decision(
    "drop_exact_replica",
    "drop_requests objects replicas",
    """
SELECT q.object, q.attempt, q.node, q.owner, q.checksum, count(*) AS requests,
       bool_or(o.attempt = q.attempt AND o.owner = q.owner AND o.checksum = q.checksum AND p.node IS NOT NULL) AS dropped
FROM {drop_requests} q JOIN {objects} o ON o.object = q.object LEFT JOIN {replicas} p ON p.object = q.object AND p.node = q.node
GROUP BY q.object, q.attempt, q.node, q.owner, q.checksum
""",
    "A replica goes only if node, producer's attempt, owner and checksum all match; any mismatch deletes nothing.",
    check="""
SELECT q.object, q.attempt, q.node, q.owner, q.checksum, count(*) AS requests,
       EXISTS (SELECT 1 FROM {replicas} p WHERE p.object = q.object AND p.node = q.node)
       AND (q.object, q.attempt, q.owner, q.checksum) IN (SELECT (object, attempt, owner, checksum) FROM {objects}) AS dropped
FROM {drop_requests} q GROUP BY q.object, q.attempt, q.node, q.owner, q.checksum
""",
)

_TOKENS = """
WITH tokens AS (SELECT DISTINCT object, kind, token FROM {object_refs} WHERE NOT released),
gone AS (SELECT DISTINCT object, kind, token FROM {object_refs} WHERE released),
held AS (
  SELECT t.object, t.kind, t.token FROM tokens t
  LEFT JOIN gone g ON g.object = t.object AND g.kind = t.kind AND g.token = t.token WHERE g.object IS NULL)
"""

LIVENESS = decision(
    "object_liveness",
    "objects object_refs",
    _TOKENS + """
SELECT o.object, count(h.object) AS tokens, count(h.object) > 0 AS is_live FROM {objects} o LEFT JOIN held h ON h.object = o.object GROUP BY o.object
""",
    "An object lives while any reference token is held; tokens are sets, and a released one can't return.",
)

COLLECTABLE = decision(
    "collectable_objects",
    "object_states object_refs object_locations object_edges",
    _TOKENS + """
SELECT o.object FROM {object_states} o
WHERE o.state <> 'READY_STORED' AND NOT o.collecting AND NOT o.publishing AND NOT o.has_lineage
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.object = o.object) AND NOT EXISTS (SELECT 1 FROM {object_edges} e WHERE e.src = o.object)
  AND NOT EXISTS (SELECT 1 FROM {object_locations} l WHERE l.object = o.object)
""",
    "Objects whose metadata can be forgotten: dead, not stored, nowhere located, without edges of either kind, lineage, publication or running collection.",
    check="""
SELECT object FROM {object_states} WHERE state IN ('READY_INLINE', 'ERROR', 'PENDING') AND NOT (collecting OR publishing OR has_lineage)
EXCEPT SELECT src FROM {object_edges}
EXCEPT SELECT object FROM {object_locations}
EXCEPT SELECT object FROM (SELECT object, kind, token FROM {object_refs} GROUP BY object, kind, token HAVING NOT bool_or(released)) t
""",
)

NODE_LOSS = decision(
    "node_loss_partition",
    "replicas objects nodes",
    """
WITH marked AS (
  SELECT r.object, count(*) AS locations, CAST(sum(CASE WHEN n.alive THEN 0 ELSE 1 END) AS BIGINT) AS lost FROM {replicas} r JOIN {nodes} n ON n.node = r.node GROUP BY r.object)
SELECT m.object, m.locations - m.lost AS surviving,
       CASE WHEN o.collecting THEN 'COLLECTING' WHEN m.locations = m.lost THEN 'LOST' ELSE 'SURVIVING' END AS state
FROM marked m JOIN {objects} o ON o.object = m.object WHERE m.lost > 0
""",
    "Objects with a replica on a dead node: lost with their last location, frozen while they are collected.",
)

REMOVE_LOCATION = decision(
    "location_removal",
    "results objects",
    """
SELECT r.object, r.node, bool_or(r.attempt = o.attempt) AS removed, count(*) AS requests
FROM {results} r JOIN {objects} o ON o.object = r.object GROUP BY r.object, r.node
""",
    "A location is removed only by a request of the current attempt.",
)

DEAD_WORKER = decision(
    "dead_worker_cleanup",
    "object_refs nodes",
    """
WITH live AS (SELECT object, kind, token, max(worker) AS worker FROM {object_refs} WHERE NOT released GROUP BY object, kind, token),
marked AS (SELECT l.*, NOT n.alive AND l.kind NOT IN (0, 5) AS dropped FROM live l JOIN {nodes} n ON n.node = l.worker)
SELECT object, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS removed, bool_and(dropped) AS now_dead
FROM marked GROUP BY object HAVING bool_or(dropped)
""",
    "References of a dead worker go, but for local and lineage ones; objects without others are dead now.",
)

SURVIVING = decision(
    "surviving_outputs",
    "results objects nodes",
    """
SELECT r.object, o.attempt, CAST(sum(CASE WHEN n.alive AND r.attempt = o.attempt THEN 1 ELSE 0 END) AS BIGINT) AS survivors,
       min(CASE WHEN n.alive AND r.attempt = o.attempt THEN r.node END) AS first_survivor,
       CASE WHEN max(CASE WHEN n.alive AND r.attempt = o.attempt THEN 1 ELSE 0 END) = 1 THEN 'SURVIVES'
            WHEN max(CASE WHEN r.attempt = o.attempt THEN 1 ELSE 0 END) = 1 THEN 'LOST' ELSE 'RETRY' END AS outcome
FROM {results} r JOIN {objects} o ON o.object = r.object JOIN {nodes} n ON n.node = r.node GROUP BY r.object, o.attempt
""",
    "Current-attempt replicas on live nodes; known success without bytes is lost, unknown success is retried.",
)

MANIFEST = decision(
    "dependency_manifest",
    "task_deps",
    """
SELECT task, object, min(CASE WHEN NOT nested THEN pos END) AS first_pos, bool_and(nested) AS lifetime_only, count(DISTINCT owner) > 1 AS owner_conflict
FROM {task_deps} GROUP BY task, object
""",
    "Dependencies once each at their first place; nested references only extend lifetimes; owners must agree.",
)

GATE = decision(
    "readiness_gate",
    "task_deps local_objects",
    """
SELECT d.task, count(DISTINCT d.object) AS dependencies, bool_and(coalesce(p.local_ready, FALSE)) AS ready
FROM {task_deps} d LEFT JOIN {local_objects} p ON p.object = d.object WHERE NOT d.nested GROUP BY d.task
""",
    "A task is ready when all its top-level dependencies are.",
)

FENCES = decision(
    "fence_outbox",
    "owner_deaths nodes fence_acks",
    """
SELECT d.owner, n.node FROM {owner_deaths} d CROSS JOIN {nodes} n
LEFT JOIN {fence_acks} a ON a.owner = d.owner AND a.node = n.node
WHERE n.alive AND a.node IS NULL
""",
    "Fences still owed: every owner death to every live node, until its exact acknowledgement or the node's death.",
)

VALUES = decision(
    "value_storage",
    "documents settings",
    """
SELECT doc_id, CASE WHEN octet_length(coalesce(text, '')) <= inline_bytes THEN 'INLINE' ELSE 'OBJECT_STORE' END AS storage,
       CAST(octet_length(coalesce(text, '')) AS BIGINT) AS size, sha2(coalesce(text, ''), 256) AS checksum
FROM {documents} CROSS JOIN {settings}
""",
    "Values up to the threshold travel inline, larger ones go to the store; both carry a SHA-256.",
    check="""
SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) <= inline_bytes THEN 'INLINE' ELSE 'OBJECT_STORE' END AS storage,
       strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS checksum FROM {documents} CROSS JOIN {settings}
""",
)
