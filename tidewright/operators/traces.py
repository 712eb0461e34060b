"""Queries over causal traces."""

from tidewright.operators.decision import decision

DEDUP = decision(
    "trace_dedup",
    "trace_deliveries",
    """
WITH contents AS (
  SELECT event_id, min(arrival) AS arrival, count(*) AS n FROM {trace_deliveries}
  GROUP BY event_id, process_id, process_sequence, component, event, cause_event_id, rpc_id, object_id, task_id)
SELECT event_id, min(arrival) AS arrival, CAST(sum(n) - 1 AS BIGINT) AS deduplicated, count(*) > 1 AS conflict FROM contents GROUP BY event_id
""",
    "Records once each, the first to arrive; the same id with other content in any column is an error.",
    check="""
SELECT event_id, min(arrival) AS arrival, count(*) - 1 AS deduplicated,
       count(DISTINCT (process_id, process_sequence, component, event, cause_event_id, rpc_id, object_id, task_id)) > 1 AS conflict
FROM {trace_deliveries} GROUP BY event_id
""",
)

FILTER = decision(
    "trace_filter",
    "trace_events trace_filters",
    """
SELECT f.query, t.event_id, t.component, t.event FROM {trace_events} t JOIN {trace_filters} f
  ON (f.component IS NULL OR t.component = f.component) AND (f.event IS NULL OR t.event = f.event)
 AND (f.reference IS NULL OR t.object_id = f.reference OR t.task_id = f.reference OR t.rpc_id = f.reference)
""",
    "Equality filters on component and name, and a reference that matches any id attribute; a missing one is any.",
)

ENTITY = decision(
    "trace_entity",
    "trace_attributes",
    """
SELECT event_id, CASE WHEN object_id IS NOT NULL THEN 'object' WHEN task_id IS NOT NULL THEN 'task' WHEN lease_id IS NOT NULL THEN 'lease'
                      WHEN actor_id IS NOT NULL THEN 'actor' WHEN placement_group_id IS NOT NULL THEN 'placement_group' WHEN worker_id IS NOT NULL THEN 'worker'
                      WHEN node_id IS NOT NULL THEN 'node' WHEN request_id IS NOT NULL THEN 'request' END AS entity_kind,
       coalesce(object_id, task_id, lease_id, actor_id, placement_group_id, worker_id, node_id, request_id) AS entity_id
FROM {trace_attributes}
""",
    "The first entity present, by precedence.",
)

RULES = decision(
    "trace_event_rules",
    "trace_events contract_rules",
    """
WITH hits AS (
  SELECT r.rule, t.event_id, t.object_id, t.process_id, t.process_sequence FROM {contract_rules} r JOIN {trace_events} t ON t.event = r.event AND t.component = r.component),
folded AS (SELECT rule, count(*) AS n, min(struct(process_id, process_sequence, event_id, object_id)) AS head FROM hits GROUP BY rule)
SELECT rule, head.event_id AS first_event, head.object_id AS bound_object, n AS matches FROM folded
""",
    "Event rules with literals: the first record in order binds the variables.",
    check="""
SELECT r.rule, arg_min(t.event_id, (t.process_id, t.process_sequence, t.event_id)) AS first_event,
       arg_min(t.object_id, (t.process_id, t.process_sequence, t.event_id)) AS bound_object, count(*) AS matches
FROM {contract_rules} r JOIN {trace_events} t ON t.event = r.event AND t.component = r.component GROUP BY r.rule
""",
)

BOUND = decision(
    "trace_bound_rules",
    "trace_events contract_bound",
    """
WITH first AS (
  SELECT r.rule, r.later, min(struct(t.process_id, t.process_sequence, t.event_id, t.object_id, t.task_id)) AS b
  FROM {contract_bound} r JOIN {trace_events} t ON t.component = r.component AND t.event = r.event GROUP BY r.rule, r.later)
SELECT f.rule, t.event_id, t.process_id, t.process_sequence FROM {trace_events} t
JOIN first f ON t.event = f.later AND t.object_id = f.b.object_id AND t.task_id = f.b.task_id
""",
    "Records that must equal what an earlier rule bound.",
    check="""
SELECT f.rule, t.event_id, t.process_id, t.process_sequence
FROM (SELECT r.rule, r.later, e.object_id, e.task_id, row_number() OVER (PARTITION BY r.rule ORDER BY e.process_id, e.process_sequence, e.event_id) AS k
      FROM {contract_bound} r JOIN {trace_events} e ON e.component = r.component AND e.event = r.event) f
JOIN {trace_events} t ON t.event = f.later AND t.object_id = f.object_id AND t.task_id = f.task_id WHERE f.k = 1
""",
)

RPC = decision(
    "trace_rpc_pairs",
    "trace_events",
    """
SELECT s.rpc_id, s.event_id AS sent, r.event_id AS received, p.event_id AS reply_sent, q.event_id AS reply_received
FROM {trace_events} s
JOIN {trace_events} r ON r.rpc_id = s.rpc_id AND r.event = 'rpc_request_received' AND r.cause_event_id = s.event_id AND r.process_id <> s.process_id
LEFT JOIN {trace_events} p ON p.rpc_id = s.rpc_id AND p.event = 'rpc_reply_sent' AND p.cause_event_id = r.event_id
LEFT JOIN {trace_events} q ON q.rpc_id = s.rpc_id AND q.event = 'rpc_reply_received' AND q.cause_event_id = p.event_id
WHERE s.event = 'rpc_request_sent'
""",
    "Requests with their receipt, reply and its receipt, linked by cause and across processes.",
)

ANCHORS = decision(
    "trace_rpc_anchors",
    "trace_events contract_anchors",
    """
WITH anchor AS (
  SELECT t.process_id, min(t.process_sequence) AS opened, max(t.process_sequence) AS closed FROM {trace_events} t JOIN {contract_anchors} c ON c.component = t.component GROUP BY t.process_id),
served AS (
  SELECT s.rpc_id, s.process_id AS client, s.process_sequence AS sent_at, r.process_id AS server, r.process_sequence AS received_at
  FROM {trace_events} s JOIN {trace_events} r ON r.rpc_id = s.rpc_id AND r.event = 'rpc_request_received' AND r.cause_event_id = s.event_id AND r.process_id <> s.process_id
  WHERE s.event = 'rpc_request_sent')
SELECT v.rpc_id, v.client, v.server FROM served v JOIN anchor a ON a.process_id = v.client AND v.sent_at > a.opened AND v.sent_at < a.closed
JOIN anchor b ON b.process_id = v.server AND v.received_at > b.opened
""",
    "Requests sent between two anchor records of the client and received after one of the server.",
)

CAUSAL_EDGES = decision(
    "trace_causal_edges",
    "trace_events",
    """
SELECT cause_event_id AS src, event_id AS dst FROM {trace_events} WHERE cause_event_id IS NOT NULL
UNION
SELECT event_id, following FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY process_id ORDER BY process_sequence) AS following FROM {trace_events}) t WHERE following IS NOT NULL
""",
    "Cause links and the order within processes.",
)

FORBIDDEN = decision(
    "trace_forbidden",
    "trace_events contract_forbidden",
    "SELECT t.event_id, t.component, t.event FROM {trace_events} t JOIN {contract_forbidden} f ON t.component = f.component AND t.event LIKE concat(f.prefix, '%') AND t.object_id = f.object_id",
    "Records that a contract forbids, by component, name prefix and bound fields.",
)

VIOLATIONS = decision(
    "trace_violations",
    "trace_events contract_forbidden",
    """
SELECT 'missing_cause' AS violation, t.event_id FROM {trace_events} t LEFT JOIN {trace_events} c ON c.event_id = t.cause_event_id
WHERE t.cause_event_id IS NOT NULL AND c.event_id IS NULL
UNION ALL
SELECT 'same_process', t.event_id FROM {trace_events} t JOIN {trace_events} c ON c.event_id = t.cause_event_id WHERE t.event = 'rpc_request_received' AND c.process_id = t.process_id
UNION ALL
SELECT 'forbidden', t.event_id FROM {trace_events} t JOIN {contract_forbidden} f ON t.component = f.component AND t.event LIKE concat(f.prefix, '%') AND t.object_id = f.object_id
""",
    "All violations of a contract as one list.",
)

RENDER = decision(
    "trace_rendering",
    "trace_events contract_bindings",
    """
SELECT t.event_id, concat(t.component, '.', t.event, ' object_id=', CASE WHEN b.name IS NULL THEN CAST(t.object_id AS STRING) ELSE concat('<', b.name, '>') END) AS line
FROM {trace_events} t LEFT JOIN {contract_bindings} b ON b.object_id = t.object_id
""",
    "Canonical lines: identities that a contract has bound become names.",
)
