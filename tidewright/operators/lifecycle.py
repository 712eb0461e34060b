"""Decisions over task attempts, membership, publications and actors."""

from tidewright.operators.decision import decision

_KIND = "CASE event WHEN 'SUCCESS' THEN 'NONE' WHEN 'APPLICATION' THEN 'APPLICATION' WHEN 'SYSTEM' THEN 'SYSTEM' ELSE {error}(concat('unknown failure: ', coalesce(event, 'NULL'))) END"
FAILURES = decision(
    "failure_classification",
    "task_events",
    "SELECT task, seq, event, " + _KIND.format(error="raise_error") + " AS failure_kind, event = 'SYSTEM' AND attempt < max_retries AS retryable FROM {task_events}",
    "Application failures are never retried; system failures are while the budget lasts; anything else is an error, never a silent retry.",
    check="SELECT task, seq, event, " + _KIND.format(error="error") + " AS failure_kind, event = 'SYSTEM' AND attempt < max_retries AS retryable FROM {task_events}",
)

RECONSTRUCTION = decision(
    "reconstruction_decision",
    "lineage",
    """
SELECT object, CASE WHEN producer IS NULL THEN 'UNRECONSTRUCTABLE_OBJECT' WHEN recovering THEN 'JOIN_RECONSTRUCTION'
                    WHEN producer_state <> 'SUCCEEDED' THEN 'REJECT' WHEN retries_left > 0 THEN 'START_RECONSTRUCTION'
                    ELSE 'FAIL_RETRY_EXHAUSTED' END AS action, producer
FROM {lineage}
""",
    "What a request to rebuild an object leads to; values without a producer can't be rebuilt, and requests join a running one.",
)

MEMBERSHIP = decision(
    "membership_latest",
    "registrations",
    """
WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY epoch) AS r, min(CASE WHEN action = 'DEATH' THEN epoch END) OVER (PARTITION BY node) AS death FROM {registrations}),
first AS (SELECT node, epoch, pid FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY epoch) AS k FROM ordered WHERE action = 'REGISTER') t WHERE k = 1)
SELECT f.node, f.epoch AS registered, f.pid, min(o.death) AS death_epoch,
       CAST(sum(CASE WHEN o.action = 'REGISTER' AND o.epoch > f.epoch AND (o.death IS NULL OR o.epoch < o.death) AND o.pid = f.pid THEN 1 ELSE 0 END) AS BIGINT) AS replays,
       CAST(sum(CASE WHEN o.action = 'REGISTER' AND o.epoch > f.epoch AND (o.pid <> f.pid OR o.epoch > o.death) THEN 1 ELSE 0 END) AS BIGINT) AS conflicts
FROM first f JOIN ordered o ON o.node = f.node GROUP BY f.node, f.epoch, f.pid
""",
    "Membership after all registrations: replays change nothing, another process conflicts, and a dead node never returns.",
)

DEATHS = decision(
    "node_death_disposition",
    "registrations",
    """
SELECT node, epoch, CASE WHEN r = 1 AND born IS NULL THEN 'UNKNOWN' WHEN r = 1 THEN 'APPLIED' ELSE 'ALREADY_DEAD' END AS disposition FROM (
  SELECT d.node, d.epoch, min(b.epoch) AS born, row_number() OVER (PARTITION BY d.node ORDER BY d.epoch) AS r
  FROM {registrations} d LEFT JOIN {registrations} b ON b.node = d.node AND b.action = 'REGISTER' AND b.epoch < d.epoch
  WHERE d.action = 'DEATH' GROUP BY d.node, d.epoch) t
""",
    "The first death of a known node applies; later ones find it dead.",
)

SUFFIX = decision(
    "death_suffix",
    "node_deaths settings",
    "SELECT d.node, d.epoch, d.reason FROM {node_deaths} d CROSS JOIN {settings} s WHERE d.epoch > s.death_cursor",
    "Deaths after a cursor; the epoch column gives their order.",
)

WORKER_DEATHS = decision(
    "worker_deaths",
    "workers node_deaths",
    "SELECT w.worker, d.node, d.epoch FROM {workers} w JOIN {node_deaths} d ON d.node = w.node",
    "A node's death is the death of its workers.",
)

STAGES = decision(
    "stage_violations",
    "stages",
    """
WITH first AS (SELECT ref, is_put, stage, min(seq) AS seq FROM {stages} GROUP BY ref, is_put, stage),
needs AS (
  SELECT 'PREPARED' AS stage, 'INTENT' AS prior UNION ALL SELECT 'ARMED', 'PREPARED' UNION ALL SELECT 'TERMINAL', 'ARMED'
  UNION ALL SELECT 'COMMITTED', 'PREPARED' UNION ALL SELECT 'COMMITTED', 'TERMINAL' UNION ALL SELECT 'ADOPTED', 'COMMITTED' UNION ALL SELECT 'RETIRED', 'FENCED')
SELECT f.ref, f.stage, n.prior FROM first f JOIN needs n ON n.stage = f.stage LEFT JOIN first p ON p.ref = f.ref AND p.stage = n.prior AND p.seq < f.seq
WHERE p.ref IS NULL AND NOT (f.is_put AND n.prior = 'TERMINAL')
UNION ALL
SELECT ref, stage, 'NONE' FROM first WHERE is_put AND stage = 'TERMINAL'
""",
    "Stages of a publication whose prerequisite is missing or later; a put has no terminal stage.",
)

OWNERS = decision(
    "owner_bindings",
    "publications",
    "SELECT object, count(DISTINCT owner) AS owners, min(owner) AS owner, count(DISTINCT owner) > 1 AS conflict FROM {publications} GROUP BY object",
    "An object has one owner.",
)

MAILBOX = decision(
    "mailbox_admission",
    "actor_calls",
    """
WITH once AS (
  SELECT actor, caller, seq, min(arrival) AS arrival, count(DISTINCT payload) > 1 AS conflict FROM {actor_calls} GROUP BY actor, caller, seq),
numbered AS (SELECT *, row_number() OVER (PARTITION BY actor, caller ORDER BY seq) - 1 AS place FROM once)
SELECT actor, caller, seq, conflict, CASE WHEN seq = place THEN 'ADMITTED' ELSE 'BUFFERED' END AS state FROM numbered
""",
    "Calls of a caller are admitted in contiguous numbers from 0; after a gap they are buffered.",
)

ACTOR_EXIT = decision(
    "actor_exit_disposition",
    "actor_exits actors",
    """
SELECT e.detection, e.actor,
       CASE WHEN a.actor IS NULL THEN 'UNKNOWN'
            WHEN e.generation < a.generation THEN 'STALE'
            WHEN a.state <> 'ALIVE' OR e.generation <> a.generation OR e.node <> a.node OR e.route_epoch <> a.route_epoch THEN 'CONFLICT'
            ELSE 'APPLIED' END AS disposition,
       CASE WHEN a.state = 'ALIVE' AND e.generation = a.generation AND e.node = a.node AND e.route_epoch = a.route_epoch
            THEN CASE WHEN a.restarts_used < a.max_restarts THEN 'RESTARTING' ELSE 'DEAD' END END AS next_state
FROM {actor_exits} e LEFT JOIN {actors} a ON a.actor = e.actor
""",
    "Each exit by itself against an actor's record: stale, conflicting or applied, and whether the restart budget allows another generation.",
)

ACTOR_NODE_LOSS = decision(
    "actor_node_loss",
    "actors nodes",
    """
SELECT a.actor, a.state AS before, CASE WHEN NOT n.alive AND a.state IN ('CREATING', 'ALIVE', 'RESTARTING') THEN 'DEAD' ELSE a.state END AS after
FROM {actors} a JOIN {nodes} n ON n.node = a.node
""",
    "Actors don't move: the loss of their node ends them.",
)

ACTOR_FENCE = decision(
    "actor_reply_fence",
    "actor_exits actors",
    """
SELECT e.detection, e.actor, a.actor IS NOT NULL AND e.generation = a.generation AND e.route_epoch >= a.route_epoch AS publish
FROM {actor_exits} e LEFT JOIN {actors} a ON a.actor = e.actor
""",
    "A late reply of an older generation or route isn't published.",
)

CALL_STATUS = decision(
    "actor_call_status",
    "actor_calls",
    """
SELECT actor, caller, seq, arrival, CASE WHEN stale_generation THEN 'SYSTEM_ERROR' WHEN raised THEN 'APPLICATION_ERROR' ELSE 'OK' END AS status,
       NOT stale_generation AS consumes_sequence
FROM {actor_calls}
""",
    "A stale generation is a system error; a user's exception is an application error that consumes its number and leaves the actor alive.",
)
