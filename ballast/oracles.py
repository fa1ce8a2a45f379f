"""Independent SQL for the registered queries, in the dialect of DuckDB."""

from __future__ import annotations

CUSTOMER_ITEMS = """
items AS (
    SELECT o_custkey AS instance_id, o_orderkey AS item_id,
           greatest(1, CAST(coalesce(q, 0) AS BIGINT)) AS weight, CAST(round(o_totalprice * 100) AS BIGINT) AS value
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
),
instances AS (
    SELECT c_custkey AS instance_id, CAST(coalesce(floor(sum(weight) / 2), 0) AS BIGINT) AS capacity
    FROM customer LEFT JOIN items ON instance_id = c_custkey GROUP BY 1
)"""

#: In place of the price: orders that are worth their weight.
EQUAL = "greatest(1, CAST(coalesce(q, 0) AS BIGINT)) AS value"

BRAND_ITEMS = """
items AS (
    SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS instance_id, p_partkey AS item_id,
           CAST(p_size AS BIGINT) AS weight, CAST(round(p_retailprice * 100) AS BIGINT) AS value
    FROM part
),
instances AS (SELECT DISTINCT instance_id, CAST(100 AS BIGINT) AS capacity FROM items)"""


def best_of_all(items: str, sense: str) -> str:
    """Dynamic programme over the weight reached, one item at a time."""
    if sense == "max":
        weight, better, fits, done = "w + t * weight", "max", "w + t * weight <= capacity", "true"
    else:
        weight, better, fits, done = "least(w + t * weight, capacity)", "min", "true", "w = capacity"
    return f"""
WITH RECURSIVE {items},
numbered AS (
    SELECT i.*, capacity, row_number() OVER (PARTITION BY instance_id ORDER BY item_id) AS pos
    FROM items i JOIN instances USING (instance_id)
),
dp(instance_id, pos, w, v) AS (
    SELECT instance_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM instances
    UNION ALL
    SELECT instance_id, pos, w, CAST({better}(v) AS BIGINT) FROM (
        SELECT n.instance_id, n.pos, CAST({weight} AS BIGINT) AS w, v + t * value AS v
        FROM dp JOIN numbered n ON n.instance_id = dp.instance_id AND n.pos = dp.pos + 1, (VALUES (0), (1)) c(t)
        WHERE {fits}
    ) GROUP BY 1, 2, 3
),
last AS (
    SELECT instance_id, count(pos) AS n, any_value(i.capacity) AS capacity
    FROM instances i LEFT JOIN numbered USING (instance_id) GROUP BY 1
),
best AS (
    SELECT instance_id, {better}(v) AS objective FROM dp JOIN last USING (instance_id)
    WHERE pos = n AND {done} GROUP BY 1
)"""


REPORT = """
SELECT instance_id, CASE WHEN objective IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, objective
FROM instances LEFT JOIN best USING (instance_id)"""

WHOLE_REPORT = """
SELECT instance_id, CASE WHEN objective IS NULL THEN 'infeasible' ELSE 'optimal' END AS status, objective,
       CAST(0 AS BIGINT) AS n_open, false AS halted
FROM instances LEFT JOIN best USING (instance_id)"""

TWO_LEVELS = f"""
WITH {CUSTOMER_ITEMS},
ranked AS (
    SELECT instance_id, item_id, weight, value, capacity, row_number() OVER w AS pos,
           sum(weight) OVER w <= capacity AS greedy,
           sum(weight) OVER w > capacity AND sum(weight) OVER w - weight <= capacity AS critical
    FROM items JOIN instances USING (instance_id)
    WINDOW w AS (PARTITION BY instance_id ORDER BY value / weight DESC, item_id ROWS UNBOUNDED PRECEDING)
),
base AS (
    SELECT instance_id, any_value(capacity) AS capacity, count(*) AS n_items,
           coalesce(sum(weight) FILTER (greedy), 0) AS bw, coalesce(sum(value) FILTER (greedy), 0) AS bv,
           max(weight) FILTER (critical) AS cw, max(value) FILTER (critical) AS cv
    FROM ranked GROUP BY 1
),
lined AS (
    SELECT r.*, coalesce(sum(CASE WHEN greedy THEN 0 ELSE value END) OVER (
               PARTITION BY instance_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS addable
    FROM ranked r
),
flip(f) AS (VALUES (0), (1)),
level1 AS (
    SELECT instance_id, bw + f * CASE WHEN greedy THEN -weight ELSE weight END AS nw,
           bv + f * CASE WHEN greedy THEN -value ELSE value END AS nv,
           CASE WHEN f = 1 THEN CAST(item_id AS VARCHAR) ELSE '' END AS flips, f, greedy, weight, value, addable, 1 AS depth
    FROM base JOIN lined USING (instance_id), flip WHERE pos = 1
),
level2 AS (
    SELECT instance_id, a.nw + flip.f * CASE WHEN l.greedy THEN -l.weight ELSE l.weight END AS nw,
           a.nv + flip.f * CASE WHEN l.greedy THEN -l.value ELSE l.value END AS nv,
           CASE WHEN flip.f = 0 THEN flips WHEN flips = '' THEN CAST(l.item_id AS VARCHAR)
                ELSE flips || ',' || l.item_id END AS flips, flip.f, l.greedy, l.weight, l.value, l.addable, 2 AS depth
    FROM level1 a JOIN lined l USING (instance_id), flip
    WHERE l.pos = 2 AND a.nw <= (SELECT capacity FROM instances i WHERE i.instance_id = l.instance_id)
),
nodes AS (
    SELECT n.*, n_items, bv, least(cv * (capacity - nw) // cw, addable,
               CASE WHEN greedy THEN addable ELSE value * (capacity - nw) // weight END) + nv AS bound
    FROM (SELECT * FROM level1 UNION ALL SELECT * FROM level2) n JOIN base USING (instance_id)
    WHERE nw <= capacity
),
shown AS (
    SELECT instance_id, depth, CAST(nw AS BIGINT) AS weight, CAST(nv AS BIGINT) AS value,
           CAST(bound AS BIGINT) AS bound, flips, n_items, bv FROM nodes
)"""


AFTER_ONE = f"""{TWO_LEVELS},
after AS (
    SELECT b.instance_id, n_items, greatest(b.bv, coalesce(max(nv), 0))::BIGINT AS objective,
           count(nv) FILTER (n_items > 1) AS n_open, count(nv) FILTER (n_items = 1) AS n_done,
           CASE WHEN count(nv) FILTER (n_items > 1) > 0 THEN 'feasible' ELSE 'optimal' END AS status
    FROM (SELECT instance_id, coalesce(n_items, 0) AS n_items, coalesce(bv, 0) AS bv FROM instances LEFT JOIN base USING (instance_id)) b
    LEFT JOIN (SELECT instance_id, nv FROM nodes WHERE depth = 1 AND bound > bv) c USING (instance_id)
    GROUP BY b.instance_id, n_items, b.bv
)"""


def merge(sense: str, otherwise: str = "infeasible", key: str = "key,") -> str:
    """Best order per customer, or of all; partial orders have the status ``otherwise``."""
    sign = "-" if sense == "max" else ""
    part = "PARTITION BY key" if key else ""
    return f"""
WITH s AS (
    SELECT o_custkey AS key, o_orderkey AS tie_id,
           CASE o_orderstatus WHEN 'F' THEN 'optimal' WHEN 'O' THEN 'feasible' ELSE '{otherwise}' END AS status,
           CAST(round(o_totalprice * 100) AS BIGINT) AS objective
    FROM orders
),
r AS (SELECT *, CASE WHEN status IN ('error', 'unbounded') THEN 0 WHEN status = 'infeasible' THEN 2 ELSE 1 END AS class FROM s)
SELECT {key} tie_id, status, objective, class = 0 AS halted FROM (
    SELECT *, row_number() OVER ({part} ORDER BY class, CASE class WHEN 1 THEN {sign}objective ELSE 0 END, tie_id) AS place FROM r
) WHERE place = 1"""


WORK = {
    "supplier": """
nodes AS (
    SELECT l_suppkey AS slot, CAST(l_orderkey AS VARCHAR) AS tree_id, l_linenumber || '-' || l_partkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS node_id,
           l_discount < 0.05 AS is_easy
    FROM lineitem
),
slots AS (SELECT s_suppkey AS slot FROM supplier)""",
    "customer": """
nodes AS (
    SELECT o_custkey AS slot, CAST(o_orderkey AS VARCHAR) AS tree_id, CAST(o_orderkey AS VARCHAR) AS node_id,
           o_totalprice < 100000 AS is_easy
    FROM orders
),
slots AS (SELECT c_custkey AS slot FROM customer)""",
    "cased": """
nodes AS (
    SELECT o_custkey AS slot, CASE o_orderkey % 2 WHEN 0 THEN 't' ELSE 'T' END || (o_orderkey // 2) AS tree_id, '0' AS node_id,
           o_totalprice < 100000 AS is_easy
    FROM orders
),
slots AS (SELECT c_custkey AS slot FROM customer)""",
}
CAPS = {"supplier": 1_000_000_000, "customer": 10, "cased": 10}

COUNTS = """
counts AS (
    SELECT slot, count(tree_id) AS n, count(tree_id) FILTER (is_easy) AS n_easy,
           count(tree_id) FILTER (NOT is_easy) AS n_hard
    FROM slots LEFT JOIN nodes USING (slot) GROUP BY 1
)"""

THRESHOLD = """
limits AS (
    SELECT count(*) AS n_slots, CAST(sum(n) AS BIGINT) AS n_open,
           least({cap}, CAST(ceil(sum(n) / count(*)) AS BIGINT) - 1) AS threshold FROM counts
)"""

# Every open node above the threshold is one unit at the height it sits at; units are taken
# from the highest down, at equal height from the lowest slot.
PLAN = """
moves AS (SELECT CAST(sum(greatest(0, threshold - n)) AS BIGINT) AS total FROM counts, limits),
units AS (
    SELECT slot, unnest(range(threshold + 1, n + 1)) AS height FROM counts, limits WHERE n > threshold
),
taken AS (
    SELECT slot, count(*) AS k FROM (
        SELECT slot, row_number() OVER (ORDER BY height DESC, slot) AS place FROM units
    ), moves WHERE place <= total GROUP BY 1
),
plan AS (
    SELECT slot, n, CAST(CASE WHEN n < threshold THEN threshold - n ELSE -coalesce(k, 0) END AS BIGINT) AS delta
    FROM counts LEFT JOIN taken USING (slot), limits
)"""

PICKED = """
picked AS (
    SELECT slot, tree_id, node_id, place AS rank FROM (
        SELECT nodes.*, delta, row_number() OVER (
            PARTITION BY slot ORDER BY md5('1|' || tree_id || '|' || node_id), tree_id, node_id) AS place
        FROM nodes JOIN plan USING (slot)
    ) WHERE place <= -delta
)"""

ASSIGNED = """
numbered AS (SELECT *, row_number() OVER (ORDER BY slot, rank) AS number FROM picked),
places AS (
    SELECT new_slot, row_number() OVER (ORDER BY new_slot) AS number
    FROM (SELECT slot AS new_slot, unnest(range(delta)) FROM plan WHERE delta > 0)
),
assigned AS (SELECT slot, tree_id, node_id, new_slot FROM numbered JOIN places USING (number))"""


def work(owner: str) -> dict[str, str]:
    head = f"WITH {WORK[owner]}"
    counts = f"{head}, {COUNTS}"
    threshold = THRESHOLD.format(cap=CAPS[owner])
    plan = f"{counts}, {threshold}, {PLAN}"
    picked = f"{plan}, {PICKED}"
    assigned = f"{picked}, {ASSIGNED}"
    return {
        "pending_by_slot": f"{counts} SELECT * FROM counts",
        "pending_by_tree": f"""{head} SELECT slot, tree_id, count(*) AS n, count(*) FILTER (is_easy) AS n_easy,
            count(*) FILTER (NOT is_easy) AS n_hard FROM nodes GROUP BY 1, 2""",
        "pending_pages": f"""{head}
            SELECT slot, page, coalesce(string_agg(entry, ',' ORDER BY place), '') AS pending FROM (
                SELECT slot, tree_id || ':' || node_id || ':' || CAST(is_easy AS INTEGER) AS entry, place,
                       (place - 1) // 4 AS page
                FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY tree_id, node_id) AS place FROM nodes)
                UNION ALL
                SELECT slot, NULL, 1, 0 FROM slots WHERE slot NOT IN (SELECT slot FROM nodes)
            ) GROUP BY 1, 2""",
        "levelling_threshold": f"{counts}, {threshold} SELECT * FROM limits",
        "levelling_plan": f"{plan} SELECT * FROM plan",
        "pick_to_move": f"{picked} SELECT * FROM picked",
        "split_moved": f"""{picked}
            SELECT nodes.slot, nodes.tree_id, nodes.node_id, is_easy, rank IS NOT NULL AS moved
            FROM nodes LEFT JOIN picked USING (slot, tree_id, node_id)""",
        "assign_destinations": f"{assigned} SELECT * FROM assigned",
        "rebalance": f"""{assigned}
            SELECT coalesce(new_slot, slot) AS slot,
                   CASE WHEN new_slot IS NULL THEN tree_id ELSE tree_id || '/' || node_id END AS tree_id,
                   node_id, is_easy, slot AS old_slot
            FROM nodes LEFT JOIN assigned USING (slot, tree_id, node_id)""",
        "pending_after_rebalance": f"""{assigned},
            after AS (SELECT coalesce(new_slot, slot) AS slot, is_easy, tree_id FROM nodes LEFT JOIN assigned USING (slot, tree_id, node_id))
            SELECT slot, count(tree_id) AS n, count(tree_id) FILTER (is_easy) AS n_easy, count(tree_id) FILTER (NOT is_easy) AS n_hard
            FROM slots LEFT JOIN after USING (slot) GROUP BY 1""",
    }


def budget(total: int) -> str:
    return f"""
WITH RECURSIVE trees AS (
    SELECT o_custkey AS group_id, o_orderkey AS seq, count(*) FILTER (l_quantity < 25) AS e,
           count(*) FILTER (l_quantity >= 25) AS h
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
),
lined AS (
    SELECT group_id, seq, e, h, row_number() OVER w AS pos,
           sum(6 * e + 60 * h) OVER (PARTITION BY group_id ORDER BY seq
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS to_come
    FROM trees WINDOW w AS (PARTITION BY group_id ORDER BY seq)
),
served(group_id, seq, pos, share, rest) AS (
    SELECT DISTINCT group_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST({total} AS DOUBLE) FROM trees
    UNION ALL
    SELECT group_id, seq, pos, share, rest - share FROM (
        SELECT l.group_id, l.seq, l.pos, rest,
               CAST(CASE WHEN floor(rest) <= 0 OR e + h = 0 THEN 0
                    WHEN floor(rest) > to_come THEN floor(rest) - to_come + 6 * e + 60 * h
                    ELSE greatest(6, floor(rest) * (6 * e + 60 * h) / to_come) END AS DOUBLE) AS share
        FROM served s JOIN lined l ON l.group_id = s.group_id AND l.pos = s.pos + 1
    )
)
SELECT group_id, seq, round(share, 4) AS share FROM served WHERE pos > 0"""


PARTS = """
WITH RECURSIVE parts(o_orderkey, quantity, round) AS (
    SELECT o_orderkey, CAST(coalesce(sum(l_quantity), 0) AS BIGINT), 0 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    UNION ALL
    SELECT o_orderkey, CASE WHEN half = 0 THEN quantity // 2 ELSE quantity - quantity // 2 END, round + 1
    FROM parts, (VALUES (0), (1)) h(half) WHERE quantity > 10
)"""


SEEN = """
seen AS (
    SELECT round, count(*) FILTER (quantity > 10 OR round = 0) AS n_open,
           count(*) FILTER (quantity <= 10 AND round > 0) AS n_closed
    FROM (SELECT quantity, round FROM parts
          UNION ALL SELECT quantity, 1 FROM parts WHERE round = 0 AND quantity <= 10) GROUP BY 1
)"""


def oracle_sql() -> dict[str, str]:
    customers = {s: best_of_all(CUSTOMER_ITEMS, s) for s in ("max", "min")}
    brands = {s: best_of_all(BRAND_ITEMS, s) for s in ("max", "min")}
    nodes = "SELECT instance_id, depth, weight, value, bound, flips FROM shown"
    slots = work("customer")
    found = {
        "seed_frontier": """
            SELECT c_custkey AS instance_id, CAST(c_custkey AS VARCHAR) AS tree_id, '' AS node_id,
                   1 AS slot, 0 AS depth, CAST(0 AS BIGINT) AS weight, CAST(0 AS BIGINT) AS value, 0 AS n_flips
            FROM customer""",
        "expand_frontier": f"{TWO_LEVELS} {nodes}",
        "prune_frontier": f"{TWO_LEVELS} {nodes} WHERE bound > bv AND depth < n_items",
        "merge_incumbent_max": merge("max"),
        "merge_incumbent_min": merge("min"),
        "best_subset_max": customers["max"] + REPORT,
        "best_subset_min": customers["min"] + REPORT,
        "best_subset_brand_max": brands["max"] + REPORT,
        "best_subset_brand_min": brands["min"] + REPORT,
        "best_subset_no_dominance": customers["max"] + REPORT,
        "best_subset_choices": customers["max"] + " SELECT instance_id, objective AS value, true AS fits FROM best",
        "solution_report": customers["max"] + WHOLE_REPORT,
        "report_written": brands["max"] + WHOLE_REPORT,
        "best_subset_equal": best_of_all(CUSTOMER_ITEMS.replace("CAST(round(o_totalprice * 100) AS BIGINT) AS value", EQUAL), "max") + REPORT,
        "best_subset_budgeted": brands["max"] + REPORT,
        "best_subset_resumed": customers["max"] + REPORT,
        "apportion_budget_600": budget(600),
        "apportion_budget_60": budget(60),
        "apportion_budget_5000": budget(5000),
        "merge_incumbent_errors": merge("max", "error"),
        "merge_incumbent_all": merge("max", key=""),
        "merge_incumbent_all_errors": merge("min", "unbounded", key=""),
        "is_halted": "SELECT coalesce(bool_or(o_orderstatus NOT IN ('F', 'O')), false) AS halted FROM orders",
        "solution_report_after_one_round": f"{AFTER_ONE} SELECT instance_id, status, objective, n_open, false AS halted FROM after",
        "search_history": f"""{AFTER_ONE}
            SELECT 0 AS round, count(*) FILTER (n_items > 0) AS n_open, CAST(0 AS BIGINT) AS n_closed, CAST(NULL AS VARCHAR) AS stop_reason FROM after
            UNION ALL
            SELECT 1, CAST(sum(n_open) AS BIGINT), CAST(sum(n_done) AS BIGINT), CASE WHEN sum(n_open) = 0 THEN 'empty' ELSE 'max_rounds' END FROM after""",
        "best_subset_halted": f"""{TWO_LEVELS}
            SELECT instance_id, CASE WHEN instance_id = 7 THEN 'error' WHEN n_items > 0 THEN 'feasible' ELSE 'optimal' END AS status,
                   CASE WHEN instance_id <> 7 THEN CAST(coalesce(bv, 0) AS BIGINT) END AS objective,
                   CAST(CASE WHEN instance_id <> 7 AND n_items > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_open, true AS halted
            FROM instances LEFT JOIN base USING (instance_id)""",
        "slot_results_customer": f"""
            WITH pages AS ({slots["pending_pages"]}), counted AS ({slots["pending_by_slot"]}), best AS ({merge("max")})
            SELECT slot, page, pending, n, n_easy, n_hard, tie_id, status, objective, halted
            FROM pages JOIN counted USING (slot) LEFT JOIN best ON key = slot""",
        "iterate_halving": f"""{PARTS}
            SELECT o_orderkey, count(*) AS leaves, CAST(sum(quantity) AS BIGINT) AS quantity
            FROM parts WHERE quantity <= 10 GROUP BY 1""",
        "iterate_halted": f"""{PARTS}, {SEEN},
            halting AS (SELECT min(round) AS h FROM parts WHERE round >= 2 AND quantity > 40)
            SELECT round, n_open, n_closed, CASE WHEN round = h THEN 'halted' WHEN round = max(round) OVER () THEN 'empty' END AS stop_reason
            FROM seen, halting WHERE h IS NULL OR round <= h""",
        "iterate_history": f"""{PARTS}, {SEEN}
            SELECT round, n_open, n_closed,
                   CASE WHEN round = max(round) OVER () THEN 'empty' END AS stop_reason FROM seen""",
    }
    for owner in WORK:
        found.update({f"{name}_{owner}": sql for name, sql in work(owner).items()})
    return found
