"""State tables of a runtime, projected from the star-schema and event tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of the data folder that projections read.
BASE_TABLES = ("nation", "supplier", "part", "orders", "lineitem", "events", "customer", "documents")

PROJECTIONS: dict[str, str] = {
    # One row per node; every eleventh is dead.
    "nodes": "SELECT s_suppkey AS node, s_suppkey % 11 <> 0 AS alive FROM {supplier}",
    # Milli-units by node and resource; every sixth node is fully busy, every fifth has a GPU.
    "node_resources": """
SELECT s_suppkey AS node, 'CPU' AS resource, 1000 * (1 + s_suppkey % 8) AS total,
       CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE greatest(0, 1000 * (1 + s_suppkey % 8) - 1000 * (s_suppkey % 3)) END AS available
FROM {supplier}
UNION ALL
SELECT s_suppkey, 'GPU', 1000 * (1 + s_suppkey % 2), 1000 * (s_suppkey % 2) FROM {supplier} WHERE s_suppkey % 5 = 0""",
    "tasks": """
SELECT o_orderkey AS task, 1000 * (1 + o_orderkey % 4) AS cpu, CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 0 END AS gpu,
       o_orderkey % 3 AS max_retries, o_orderkey % n.k AS preferred, o_orderkey % n.k AS fallback
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    "requests": """
SELECT o_orderkey AS task, 'CPU' AS resource, 1000 * (1 + o_orderkey % 4) AS milli FROM {orders}
UNION ALL SELECT o_orderkey, 'GPU', 1000 FROM {orders} WHERE o_orderkey % 7 = 0""",
    # What each task depends on, in argument order; every fifth argument is nested.
    "task_deps": """
SELECT l_orderkey AS task, l_linenumber AS pos, l_partkey AS object, l_suppkey AS owner, l_partkey % 5 = 0 AS nested FROM {lineitem}""",
    "objects": """
SELECT l_partkey AS object, max(CAST(l_quantity AS BIGINT)) AS size, max(l_linenumber) AS attempt, min(l_suppkey) AS owner,
       concat('c', CAST(max(CAST(l_quantity AS BIGINT)) AS STRING)) AS checksum, l_partkey % 29 = 0 AS collecting
FROM {lineitem} GROUP BY l_partkey""",
    # What owners know of their objects; every twenty-ninth is being collected.
    "object_states": """
SELECT p_partkey AS object, CASE WHEN p_partkey % 8 = 0 THEN 'READY_STORED' WHEN p_partkey % 8 = 4 THEN 'READY_INLINE' WHEN p_partkey % 2 = 0 THEN 'ERROR' ELSE 'PENDING' END AS state,
       p_partkey % 29 = 0 AS collecting, p_partkey % 31 = 0 AS publishing, p_partkey % 7 = 0 AS has_lineage
FROM {part}""",
    "object_locations": "SELECT DISTINCT l_partkey AS object, l_suppkey AS node FROM {lineitem} WHERE l_partkey % 8 = 0 OR l_partkey % 20 = 4",
    # Objects that an object's value contains, and objects that its producer needed.
    "object_edges": """
SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_linenumber = 7 THEN 'CONTAINED' ELSE 'LINEAGE' END AS kind
FROM {lineitem} WHERE l_linenumber = 7 AND l_partkey % 3 = 0 OR l_linenumber = 6 AND l_partkey % 5 = 0""",
    "local_objects": "SELECT DISTINCT l_partkey AS object, l_partkey % 6 <> 0 AS local_ready FROM {lineitem}",
    # Requests to delete one replica, with the identity that the sender believes in; some are stale.
    "drop_requests": """
SELECT l_partkey AS object, l_linenumber AS attempt, l_suppkey AS node, l_suppkey - l_orderkey % 3 AS owner,
       concat('c', CAST(CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 2 = 0 THEN 50 - CAST(l_quantity AS BIGINT) ELSE 0 END AS STRING)) AS checksum
FROM {lineitem}""",
    # Thresholds and cursors that a user of the runtime sets: one row.
    "settings": "SELECT CAST(2048 AS BIGINT) AS inline_bytes, CAST(16384 AS BIGINT) AS chunk_bytes, CAST(2 AS BIGINT) AS death_cursor",
    # How a lease is asked for: targeted retries, leases of placement groups, and whether its dependencies are local.
    "lease_requests": """
SELECT o_orderkey AS task, o_orderkey % 13 = 0 AS targeted, CASE WHEN o_orderkey % 26 = 0 THEN o_orderkey % n.k + 1 ELSE o_orderkey % n.k END AS target,
       o_orderkey % 17 = 0 AS gang, o_orderkey % 23 <> 0 AS localized
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    "replicas": """
SELECT DISTINCT l_partkey AS object, l_suppkey AS node FROM {lineitem}""",
    "results": """
SELECT l_partkey AS object, l_linenumber AS attempt, l_suppkey AS node, CAST(l_quantity AS BIGINT) AS payload FROM {lineitem}""",
    "object_refs": """
SELECT l_partkey AS object, l_linenumber % 6 AS kind, l_orderkey AS token, l_suppkey AS worker,
       l_returnflag <> 'N' OR l_partkey % 4 = 0 AS released
FROM {lineitem}""",
    # Who holds whom: regions nations, nations customers, customers orders, orders parts.
    "holdings": """
SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst FROM {nation}
UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM {customer}
UNION ALL SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM {orders}
UNION ALL SELECT DISTINCT concat('o', l_orderkey), concat('p', l_partkey) FROM {lineitem}""",
    # An order was made from the one before it of the same customer and priority.
    "lineage_edges": """
SELECT src, dst FROM (
  SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS dst FROM {orders}) t
WHERE dst IS NOT NULL""",
    "order_states": """
SELECT o_orderkey AS object, CASE WHEN o_orderkey % 4 = 0 THEN 'READY' WHEN o_orderkey % 4 = 1 THEN 'PENDING' ELSE 'LOST' END AS state,
       o_orderkey % 8 = 1 AS recovering, o_orderkey % 3 AS retries_left
FROM {orders}""",
    "chunks": """
SELECT l_orderkey AS transfer, CAST(10 * l_linenumber + l_partkey % 7 AS BIGINT) AS s,
       CAST(10 * l_linenumber + l_partkey % 7 AS BIGINT) + CAST(l_quantity AS BIGINT) % 13 AS e, l_suppkey % 3 AS payload
FROM {lineitem}""",
    "pull_state": """
SELECT o_orderkey AS object, o_orderkey % 13 = 0 AS local_ready, o_orderkey % 17 = 0 AS failed,
       CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS active_transfer, o_custkey % n.k AS requester
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    "locations": "SELECT DISTINCT l_orderkey AS object, l_suppkey AS node, l_suppkey % 4 = 0 AS excluded FROM {lineitem}",
    # Actor calls: callers number their calls; some numbers are missing.
    "actor_calls": """
SELECT event_type AS actor, user_id AS caller, event_id AS arrival, value AS payload, event_id % 37 = 0 AS stale_generation, value < 1 AS raised,
       CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS BIGINT) - 1 + CASE WHEN event_id % 97 > 48 AND user_id % 3 = 0 THEN 1 ELSE 0 END AS seq
FROM {events}""",
    "actors": """
SELECT c_custkey AS actor, c_custkey % 4 AS generation, c_custkey % 3 AS restarts_used, c_custkey % 4 AS max_restarts,
       c_custkey % 9 AS route_epoch, c_custkey % n.k AS node,
       CASE WHEN c_custkey % 10 = 0 THEN 'DEAD' WHEN c_custkey % 10 = 1 THEN 'RESTARTING' WHEN c_custkey % 10 = 2 THEN 'CREATING' ELSE 'ALIVE' END AS state
FROM {customer} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    "actor_exits": """
SELECT o_orderkey AS detection, o_custkey AS actor, (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END) % 4 AS generation,
       o_custkey % 9 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS route_epoch, o_custkey % n.k AS node
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    # Exits, their repeats and restarts of actors in order; some repeats say something else.
    "actor_lifecycle": """
SELECT actor, seq, CASE WHEN r % 3 = 2 THEN 'RESTARTED' ELSE 'EXIT' END AS event, 1000 * actor + life AS detection, life + CASE WHEN seq % 11 = 0 THEN 1 ELSE 0 END AS generation,
       home + CASE WHEN seq % 5 = 0 AND r % 3 = 1 THEN 1 ELSE 0 END AS node, 2 * life AS route_epoch, seq % 13 <> 0 AS node_alive, actor % 4 AS max_restarts, home
FROM (SELECT o_custkey AS actor, o_orderkey AS seq, o_custkey % n.k AS home, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) - 1 AS r,
             CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS BIGINT) AS life
      FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n) t""",
    # Registrations of nodes in epochs; some replay with another process.
    "registrations": """
SELECT o_custkey % n.k AS node, o_orderkey AS epoch, o_orderkey % 3 AS pid, CASE WHEN o_orderkey % 31 = 0 THEN 'DEATH' ELSE 'REGISTER' END AS action
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    "node_deaths": "SELECT s_suppkey AS node, CAST((s_suppkey - s_suppkey % 11) / 11 + 1 AS BIGINT) AS epoch, 'exit' AS reason FROM {supplier} WHERE s_suppkey % 11 = 0",
    "workers": "SELECT c_custkey AS worker, c_custkey % n.k AS node FROM {customer} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n",
    "fence_acks": "SELECT DISTINCT o_custkey AS owner, o_orderkey % n.k AS node FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n",
    "owner_deaths": "SELECT c_custkey AS owner FROM {customer} WHERE c_custkey % 50 = 0",
    "bundle_replies": """
SELECT o_custkey AS pg, o_orderkey % 2 AS bundle, o_orderkey AS seq, o_orderkey % n.k AS node,
       CASE WHEN o_orderkey % 19 = 0 THEN 'REJECTED' WHEN o_orderkey % 3 = 0 THEN 'PREPARED' ELSE 'COMMITTED' END AS reply
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    # Operations on the reservation of a group, with the children that it lends to.
    "reservation_ops": """
SELECT o_custkey AS pg, o_orderkey AS seq, o_orderkey % 19 % 2 AS payload, o_orderkey % 3 AS child,
       CASE WHEN o_orderkey % 10 <= 1 THEN 'PREPARE' WHEN o_orderkey % 10 <= 3 THEN 'COMMIT' WHEN o_orderkey % 10 <= 5 THEN 'START' WHEN o_orderkey % 10 <= 7 THEN 'END'
            WHEN o_orderkey % 30 = 8 THEN 'ABORT' WHEN o_orderkey % 10 = 8 THEN 'BEGIN_REMOVE' ELSE 'FINALIZE_REMOVE' END AS op
FROM {orders}""",
    # Requests and capacities in resources of any name.
    "resource_requests": """
SELECT o_orderkey AS task, 'CPU' AS resource, 1000 * (1 + o_orderkey % 4) AS milli FROM {orders} WHERE o_orderkey % 25 <> 0
UNION ALL SELECT o_orderkey, 'GPU', 1000 FROM {orders} WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'disk', 250 * (o_orderkey % 5) FROM {orders} WHERE o_orderkey % 3 = 0""",
    "node_capacities": """
SELECT s_suppkey AS node, 'CPU' AS resource, 1000 * (1 + s_suppkey % 8) AS total,
       CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE greatest(0, 1000 * (1 + s_suppkey % 8) - 1000 * (s_suppkey % 3)) END AS available
FROM {supplier}
UNION ALL SELECT s_suppkey, 'GPU', 1000 * (1 + s_suppkey % 2), 1000 * (s_suppkey % 2) FROM {supplier} WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey, 'disk', 500 * (s_suppkey % 3), 250 * (s_suppkey % 3) FROM {supplier} WHERE s_suppkey % 2 = 0""",
    "bundles": """
SELECT o_orderkey AS pg, 1000 * (1 + o_orderkey % 4) AS cpu0, CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 0 END AS gpu0,
       1000 * (1 + o_orderkey % 3) AS cpu1, CASE WHEN o_orderkey % 9 = 0 THEN 1000 ELSE 0 END AS gpu1
FROM {orders}""",
    "functions": """
SELECT p_name AS module, p_brand AS qualname, p_size AS version, p_type AS payload, p_partkey AS seq FROM {part}""",
    "task_events": """
SELECT o_custkey AS task, o_custkey % 3 AS max_retries,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS seq,
       CAST(o_orderkey % 3 AS BIGINT) AS attempt,
       CASE WHEN o_orderkey % 5 = 0 THEN 'SUCCESS' WHEN o_orderkey % 11 = 0 THEN 'APPLICATION' ELSE 'SYSTEM' END AS event
FROM {orders}""",
    "lineage": """
SELECT l_partkey AS object, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE min(l_orderkey) END AS producer, l_partkey % 9 = 0 AS is_put,
       min(l_orderkey) % 4 = 1 AS recovering, CASE WHEN min(l_orderkey) % 5 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS producer_state,
       min(l_orderkey) % 3 AS retries_left
FROM {lineitem} GROUP BY l_partkey""",
    "stages": """
SELECT o_custkey AS ref, o_custkey % 5 = 0 AS is_put, o_orderkey AS seq,
       CASE o_orderkey % 8 WHEN 0 THEN 'INTENT' WHEN 1 THEN 'PREPARED' WHEN 2 THEN 'ARMED' WHEN 3 THEN 'TERMINAL'
            WHEN 4 THEN 'COMMITTED' WHEN 5 THEN 'ADOPTED' WHEN 6 THEN 'FENCED' ELSE 'RETIRED' END AS stage
FROM {orders}""",
    "publications": "SELECT l_partkey AS object, l_suppkey AS owner, l_orderkey AS ref FROM {lineitem} WHERE l_linenumber = 1",
    "lease_ops": """
SELECT o_custkey AS lease, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS seq,
       CASE o_orderkey % 4 WHEN 0 THEN 'START' WHEN 1 THEN 'COMPLETE' WHEN 2 THEN 'CANCEL' ELSE 'WORKER_EXIT' END AS op
FROM {orders}""",
    "ledger_ops": """
SELECT o_custkey % n.k AS ledger, o_orderkey AS seq, CAST((o_orderkey - o_orderkey % 4) / 4 AS BIGINT) AS token, o_orderkey % 10 AS pick,
       1000 * (1 + o_orderkey % 2) AS milli
FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n""",
    # What normal tasks hold on their preferred node, and what the last reply to each bundle reservation left there.
    "allocations": """
SELECT o_orderkey % n.k AS node, 'CPU' AS resource, 'ACTIVE' AS state, 1000 * (1 + o_orderkey % 4) AS milli FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n
UNION ALL SELECT o_orderkey % n.k, 'GPU', 'ACTIVE', 1000 FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n WHERE o_orderkey % 7 = 0
UNION ALL
SELECT node, resource, CASE WHEN reply = 'REJECTED' THEN 'RELEASED' ELSE reply END,
       CASE WHEN resource = 'GPU' THEN 1000 WHEN bundle = 0 THEN 1000 * (1 + pg % 4) ELSE 1000 * (1 + pg % 3) END
FROM (SELECT o_custkey AS pg, o_orderkey % 2 AS bundle, o_orderkey % n.k AS node,
             CASE WHEN o_orderkey % 19 = 0 THEN 'REJECTED' WHEN o_orderkey % 3 = 0 THEN 'PREPARED' ELSE 'COMMITTED' END AS reply,
             row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2, o_orderkey % n.k ORDER BY o_orderkey DESC) AS latest
      FROM {orders} CROSS JOIN (SELECT count(*) AS k FROM {supplier}) n) b
  CROSS JOIN (SELECT 'CPU' AS resource UNION ALL SELECT 'GPU') r
WHERE latest = 1 AND (resource = 'CPU' OR bundle = 0 AND pg % 7 = 0 OR bundle = 1 AND pg % 9 = 0)""",
    # Trace records: sequences by process, every third caused by the record before it in time.
    "trace_events": """
SELECT CAST(e.event_id AS STRING) AS event_id, CAST(e.user_id AS STRING) AS process_id, e.event_id AS arrival,
       CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS BIGINT) AS process_sequence,
       e.event_type AS component,
       CASE e.event_id % 4 WHEN 0 THEN 'rpc_request_sent' WHEN 1 THEN 'rpc_request_received' WHEN 2 THEN 'rpc_reply_sent' ELSE 'rpc_reply_received' END AS event,
       CASE WHEN e.event_id % 4 <> 0 THEN CAST(e.event_id - 1 AS STRING) END AS cause_event_id,
       CAST((e.event_id - e.event_id % 4) / 4 AS BIGINT) AS rpc_id, CAST(floor(e.value) AS BIGINT) % 7 AS object_id, CAST(floor(e.value) AS BIGINT) % 5 AS task_id
FROM {events} e""",
    # Literal conditions of debug queries; NULL is any.
    "trace_filters": """
SELECT 'errors of 3' AS query, 'error' AS component, CAST(NULL AS STRING) AS event, CAST(3 AS BIGINT) AS reference
UNION ALL SELECT 'replies of 5', NULL, 'rpc_reply_sent', 5 UNION ALL SELECT 'signups', 'signup', 'rpc_request_sent', NULL""",
    "contract_rules": """
SELECT 'sent' AS rule, 'click' AS component, 'rpc_request_sent' AS event UNION ALL SELECT 'received', 'view', 'rpc_request_received' UNION ALL SELECT 'failed', 'error', 'rpc_reply_sent'""",
    # A rule whose first record binds values, and the event whose records must then have them.
    "contract_bound": "SELECT 'bought' AS rule, 'purchase' AS component, 'rpc_request_sent' AS event, 'rpc_reply_received' AS later",
    "contract_anchors": "SELECT 'signup' AS component",
    "contract_forbidden": "SELECT 'signup' AS component, 'rpc_reply' AS prefix, CAST(0 AS BIGINT) AS object_id",
    "contract_bindings": "SELECT 'root' AS name, CAST(0 AS BIGINT) AS object_id UNION ALL SELECT 'child', 3",
}

# Records as they arrive: every tenth twice, every seventieth again with other content.
PROJECTIONS["trace_deliveries"] = f"""
SELECT event_id, process_id, process_sequence, component, event, cause_event_id, rpc_id, object_id, task_id, arrival FROM ({PROJECTIONS["trace_events"]}) t
UNION ALL SELECT event_id, process_id, process_sequence, component, event, cause_event_id, rpc_id, object_id + CASE WHEN arrival % 70 = 0 THEN 1 ELSE 0 END, task_id, arrival + 1000000000
FROM ({PROJECTIONS["trace_events"]}) t WHERE arrival % 10 = 0"""
# Id attributes of records, most of them absent.
PROJECTIONS["trace_attributes"] = f"""
SELECT event_id, CASE WHEN arrival % 11 = 0 THEN object_id END AS object_id, CASE WHEN arrival % 7 = 0 THEN task_id END AS task_id,
       CASE WHEN arrival % 5 = 0 THEN arrival END AS lease_id, CASE WHEN arrival % 4 = 1 THEN task_id END AS actor_id, CASE WHEN arrival % 9 = 2 THEN object_id END AS placement_group_id,
       CASE WHEN arrival % 3 = 0 THEN arrival END AS worker_id, CASE WHEN arrival % 2 = 0 THEN task_id END AS node_id, CASE WHEN arrival % 13 <> 0 THEN rpc_id END AS request_id
FROM ({PROJECTIONS["trace_events"]}) t"""


def projection_sql(name: str) -> str:
    """DuckDB text of a projection over the registered views."""
    return PROJECTIONS[name].format(**{t: t for t in BASE_TABLES})


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The state table ``name`` over the tables of a data folder."""
    text = PROJECTIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
