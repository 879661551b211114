"""DuckDB SQL for controls, stream checks, data tests, asserted recognition and usage counters."""

from __future__ import annotations

from ledgerloom.plans.oracles import ORACLE, sql

BAD = "(SELECT count(*) FROM customer WHERE c_custkey % 100 = 3)"


#: Retention of both reporting dates.
REPORTS = f"SELECT * FROM ({ORACLE['consumption_nrr']}) UNION ALL BY NAME SELECT * FROM ({ORACLE['consumption_nrr_early']})"


def dollars(cents: str) -> str:
    """Cents, none below zero, as text with two decimals."""
    return f"{cents} // 100 || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0')"


def counts(rows: dict[str, str]) -> str:
    """One row for each named count."""
    return "\nUNION ALL ".join(f"SELECT '{reason}' AS reason, ({count})::BIGINT AS failures" for reason, count in rows.items())


def repeats(relation: str, key: str) -> str:
    return f"SELECT count(*) - count(DISTINCT {key}) FROM {relation}"


OWNERS = "SELECT count(*) FROM (SELECT batch FROM tok GROUP BY batch HAVING count(DISTINCT customer) > 1)"
PAID = "SELECT month, sum(amount_cents) AS n FROM jl WHERE account LIKE '4%' AND month < DATE '2001-08-01' GROUP BY month"
CLEAN = {
    "duplicate_invoice": repeats("inv", "invoice_id"),
    "duplicate_contract": repeats("con", "contract_id"),
    "duplicate_credit": repeats("cred", "credit_id"),
    "duplicate_expiry": repeats("ended", "contract_id"),
    "invalid_invoice": """SELECT count(*) FROM fund LEFT JOIN con USING (contract_id) WHERE fund.month_end <= fund.month OR net < 0 OR fee NOT BETWEEN 0 AND net
        OR (fund.contract_id IS NOT NULL AND (con.activity_id IS NULL OR fund.month < first OR fund.month_end > stop)) OR (draw > 0 AND fee <> 0)""",
    "orphan_credit": "SELECT count(*) FROM cred WHERE invoice_id NOT IN (SELECT invoice_id FROM inv)",
    "invalid_expiry": "SELECT count(*) FROM ended JOIN fund USING (contract_id) WHERE fund.month_end > ended.month",
    "nonmonthly_subscription": "SELECT count(*) FROM ev WHERE kind NOT LIKE 'subscription%' AND kind <> 'seat_added'",
    "unique_customer_creation": repeats("cus", "customer"),
    "parent_graph_resolves": "SELECT count(*) FROM cus WHERE customer NOT IN (SELECT customer FROM who)",
    "parents_exist": "SELECT count(*) FROM up WHERE parent IS NOT NULL AND parent NOT IN (SELECT customer FROM cus)",
    "financial_customer_exists": "SELECT count(*) FROM (SELECT customer FROM inv UNION ALL SELECT customer FROM tok UNION ALL SELECT customer FROM con) WHERE customer NOT IN (SELECT customer FROM cus)",
    "one_invoice_per_batch": "SELECT count(*) FROM (SELECT batch FROM inv GROUP BY batch HAVING count(*) > 1)",
    "paid_state_has_start": "SELECT count(*) FROM (SELECT sid, arg_min(kind, (day, rank)) AS kind FROM ev GROUP BY sid) WHERE kind <> 'subscription_started'",
    "overlapping_subscriptions": "SELECT count(*) FROM (SELECT customer FROM state WHERE seats > 0 GROUP BY customer HAVING count(DISTINCT sid) > 1)",
    "meters_match_contracts": "SELECT count(*) FROM comp c WHERE row_kind = 'consumption' AND capacity_id NOT IN (SELECT capacity_id FROM comp WHERE row_kind = 'capacity')",
    "unique_capacity_documents": repeats("site", "(r, purpose)"),
    "token_population_complete": "SELECT (SELECT count(*) FROM tok) - (SELECT count(*) FROM tl)",
    "token_population_unique": repeats("tl", "activity_id"),
    "token_revenue_reconciles": """SELECT count(*) FROM (SELECT batch AS b, net - fee AS want, fee FROM inv) i
        FULL JOIN (SELECT usage_batch_id AS b, sum(net_revenue_cents) AS got, sum(channel_fee_cents) AS got_fee FROM tl GROUP BY ALL) t USING (b)
        WHERE coalesce(want, 0) <> coalesce(got, 0) OR coalesce(fee, 0) <> coalesce(got_fee, 0)""",
    "token_cost_reconciles": """SELECT count(*) FROM (SELECT month, model, sum(cost_cents) AS want FROM comp WHERE row_kind = 'consumption' AND purpose = 'inference' GROUP BY ALL) c
        FULL JOIN (SELECT month, model, sum(allocated_cost_cents) AS got FROM tl GROUP BY ALL) t USING (month, model) WHERE coalesce(want, 0) <> coalesce(got, 0)""",
    "batch_has_one_customer": OWNERS,
    "unique_model": repeats("mdl", "model"),
    "subscription_reconciles": """SELECT count(*) FROM (SELECT sid AS s, month, amount FROM subamount WHERE month < DATE '2001-08-01') a
        FULL JOIN (SELECT subscription_id AS s, month, sum(revenue_cents) AS got FROM sl GROUP BY ALL) t USING (s, month) WHERE coalesce(amount, 0) <> coalesce(got, 0)""",
    "seat_rollforward": "SELECT count(*) FROM sl WHERE ending_seats <> beginning_seats + gross_adds - cancelled_seats - seat_removals + transfer_in - transfer_out",
    "revenue_has_exposure": "SELECT count(*) FROM sl WHERE revenue_cents <> 0 AND seat_days = 0",
    "unique_trials": repeats("sub", "k"),
    "journals_balance": "SELECT count(*) FROM (SELECT month FROM jl GROUP BY month HAVING sum(amount_cents) <> 0)",
    "recognized_equals_revenue_accounts": f"""SELECT count(*) FROM ({PAID}) j FULL JOIN (SELECT month, sum(revenue_cents) AS earned FROM rec GROUP BY month) e USING (month)
        WHERE coalesce(-n, 0) <> coalesce(earned, 0)""",
}
#: Failures that one planted set adds to each control; see the adapter.
PLANTED = {
    "duplicate_invoice": 1, "duplicate_contract": 1, "duplicate_credit": 1, "duplicate_expiry": 1, "invalid_invoice": 1, "orphan_credit": 1, "invalid_expiry": 1,
    "nonmonthly_subscription": 1, "unique_customer_creation": 1, "parent_graph_resolves": 2, "parents_exist": 1, "financial_customer_exists": 2, "one_invoice_per_batch": 1,
    "paid_state_has_start": 1, "overlapping_subscriptions": 1, "meters_match_contracts": 1, "unique_capacity_documents": 1, "token_population_complete": 1,
    "token_population_unique": 1, "token_revenue_reconciles": 1, "token_cost_reconciles": 1, "batch_has_one_customer": 1, "unique_model": 1, "subscription_reconciles": 2,
    "seat_rollforward": 1, "unique_trials": 1,
}
BROKEN = {reason: f"({clean}) + {PLANTED.get(reason, 0)} * {BAD}" for reason, clean in CLEAN.items()}
TESTS = {
    "credit_completeness": CLEAN["orphan_credit"],
    "dimension_completeness": "SELECT ((SELECT count(*) FROM cus) <> (SELECT count(*) FROM who))::INT + ((SELECT count(*) FROM tok) <> (SELECT count(*) FROM tl))::INT",
    "expiry_completeness": "SELECT count(*) FROM ended JOIN inv USING (contract_id) WHERE inv.month_end > ended.month",
    "invoice_integrity": CLEAN["invalid_invoice"],
    "journal_balance": "SELECT count(*) FROM (SELECT activity_id, month FROM jl GROUP BY ALL HAVING sum(amount_cents) <> 0)",
    "nrr_identity": """SELECT count(*) FROM (SELECT lens, sum(base_cents) AS b, sum(current_cents) AS c, sum(greatest(current_cents - base_cents, 0)) AS e, sum(greatest(base_cents - current_cents, 0)) AS d
        FROM mem3 WHERE in_cohort GROUP BY lens) WHERE c <> b + e - d""",
    "recognition_bridge": CLEAN["recognized_equals_revenue_accounts"],
    "seat_rollforward": """SELECT count(*) FROM (SELECT month, plan FROM sl GROUP BY ALL HAVING sum(ending_seats) <> sum(beginning_seats + gross_adds - cancelled_seats - seat_removals + transfer_in - transfer_out))""",
    "subscription_scope": "SELECT count(*) FROM ev WHERE kind IN ('subscription_started', 'subscription_upgraded') AND day >= DATE '2001-08-01'",
    "unique_business_documents": " + ".join(f"({repeats(t, k)})" for t, k in (("inv", "invoice_id"), ("con", "contract_id"), ("cred", "credit_id"), ("ended", "contract_id"))),
    "usage_allocation": """SELECT count(*) FROM inv LEFT JOIN (SELECT usage_batch_id, sum(net_revenue_cents) AS got, sum(channel_fee_cents) AS got_fee FROM tl GROUP BY ALL) t ON usage_batch_id = batch
        WHERE coalesce(got, 0) <> net - fee OR coalesce(got_fee, 0) <> fee""",
}
TESTS["unique_business_documents"] = f"SELECT {TESTS['unique_business_documents']}"
#: The same for the data tests; two of them say at most once for each population that it is incomplete.
PLANTED_TESTS = {"credit_completeness": 1, "expiry_completeness": 1, "invoice_integrity": 1, "subscription_scope": 1, "unique_business_documents": 4, "usage_allocation": 1}
BROKEN_TESTS = {reason: f"({clean}) + {PLANTED_TESTS.get(reason, 0)} * {BAD}" for reason, clean in TESTS.items()}
BROKEN_TESTS["dimension_completeness"] = f"SELECT ({BAD} > 0)::INT"  # lost and doubled tokens balance: only the customers of a cycle show
BROKEN_TESTS["seat_rollforward"] = f"SELECT ({BAD} > 0)::INT"

BILLED = "orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"
rest = lambda n, more="": f"(SELECT count(*) FROM {BILLED} AND o_orderkey % 500 = {n}{more})"
ENDED = "SELECT count(*) FROM customer, range(1995, 2001) WHERE c_nationkey % 4 = 0 AND c_custkey % 3 = 0"
#: The stream of the tables: bills, their recognition, credits and expired commitments as rows of their own, joined as the checks join them.
ASSERTED = f"""WITH people AS (SELECT c_custkey AS k, DATE '1995-01-01' AS since, c_nationkey % 4 = 0 AS direct FROM customer),
    bills AS (SELECT o_orderkey AS o, o_custkey AS k, o_orderdate AS day, date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS stop,
        round(o_totalprice * 100)::BIGINT AS net, CASE WHEN direct THEN 0 ELSE round(o_totalprice * 100)::BIGINT * 5 // 100 END AS fee
        FROM {BILLED.replace("orders WHERE", "orders JOIN people ON o_custkey = k WHERE")}),
    credits AS (SELECT o, k, month, net * 5 // 100 AS amount FROM bills WHERE o % 67 = 0),
    ended AS (SELECT k, make_date(y::BIGINT + 1, 1, 1) AS month, 'k' || k || ':' || y AS contract, 20000000 AS due FROM people, range(1995, 2001) r(y) WHERE direct AND k % 3 = 0),
    earned AS (SELECT 'usage' AS source, 'usage' AS kind, k, month, (stop - 1)::DATE AS day, 'i' || o AS document, net - fee AS cents FROM bills
        UNION ALL SELECT 'usage', 'credit', k, month, (month + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE, 'cr' || o, -amount FROM credits
        UNION ALL SELECT 'commit_drawdown', 'commit_expiry', k, month, month, contract, due FROM ended),
    documents AS (SELECT 'usage' AS kind, k, 'i' || o AS document, month AS first, stop FROM bills
        UNION ALL SELECT 'credit', k, 'cr' || o, month, (month + INTERVAL 1 MONTH)::DATE FROM credits
        UNION ALL SELECT 'commit_expiry', k, contract, month, (month + INTERVAL 1 MONTH)::DATE FROM ended),
    merged AS (SELECT k, k - 50 AS parent FROM people WHERE k % 50 = 7 AND k >= 57),
    owed AS (SELECT document, sum(cents) AS cents FROM earned GROUP BY document)
"""
STREAM = {
    "customer_exists": "SELECT count(*) FROM bills LEFT JOIN people USING (k) WHERE people.since IS NULL OR since > day",
    "usage_revenue_ties_to_invoice": "SELECT count(*) FROM bills LEFT JOIN owed ON document = 'i' || o WHERE net - fee <> coalesce(cents, 0)",
    "credits_have_exact_negative_recognition": "SELECT count(*) FROM credits LEFT JOIN owed ON document = 'cr' || o WHERE cents IS NULL OR amount <> -cents",
    "no_self_mergers": "SELECT count(*) FROM merged WHERE k = parent",
    "service_periods_are_nonempty": "SELECT count(*) FROM documents WHERE kind = 'usage' AND first >= stop",
    "recognition_period_matches_event_month": "SELECT count(*) FROM earned WHERE month <> date_trunc('month', day)",
    "recognition_source_documents_exist": """SELECT count(*) FROM earned e WHERE NOT EXISTS (
        SELECT 1 FROM documents d WHERE d.kind = e.kind AND d.k = e.k AND d.document = e.document AND d.first <= e.day AND e.day < d.stop)""",
    "commit_expiry_ties_to_unconsumed_balance": "SELECT count(*) FROM ended LEFT JOIN owed ON document = contract WHERE due <> coalesce(cents, 0)",
    "recognition_pairs_are_versioned": """SELECT count(*) FROM earned WHERE (source, kind) NOT IN
        (('usage', 'usage'), ('commit_drawdown', 'usage'), ('subscription', 'subscription'), ('usage', 'credit'), ('commit_drawdown', 'commit_expiry'))""",
}
FAULTY = {
    "customer_exists": f"SELECT {rest(13)}",
    "usage_revenue_ties_to_invoice": f"SELECT {rest(1)} + 2 * {rest(5)}",
    "credits_have_exact_negative_recognition": f"SELECT {rest(67, ' AND o_orderkey % 67 = 0')}",
    "no_self_mergers": f"SELECT {rest(11)}",
    "service_periods_are_nonempty": f"SELECT {rest(13)}",
    "recognition_period_matches_event_month": f"SELECT {rest(3)}",
    "recognition_source_documents_exist": f"SELECT {rest(5)}",
    "commit_expiry_ties_to_unconsumed_balance": f"{ENDED} AND c_custkey % 50 = 3",
    "recognition_pairs_are_versioned": f"SELECT {rest(9)} + {rest(9, ' AND o_orderkey % 67 = 0')}",
}

#: What the recognition events assert: every visible invoice, credit and expired commitment in its month.
EARNED = """(SELECT 'usage' AS kind, customer, month, invoice_id AS document, net - fee AS cents, (month_end - 1)::DATE AS day FROM inv
    UNION ALL SELECT 'credit', customer, month, credit_id, -amount, (month + to_months(1) - INTERVAL 1 DAY)::DATE FROM cred
    UNION ALL SELECT 'commit_expiry', customer, month, contract_id, 20000000, month FROM ended)"""
DOCUMENTS = """(SELECT 'usage' AS kind, customer, invoice_id AS document, month AS first, month_end AS stop FROM inv
    UNION ALL SELECT 'credit', customer, credit_id, month, (month + to_months(1))::DATE FROM cred
    UNION ALL SELECT 'commit_expiry', customer, contract_id, month, (month + to_months(1))::DATE FROM ended)"""
CLAIMS = {
    "unique_customer_creation": "SELECT count(*) FROM (SELECT customer FROM cus GROUP BY customer HAVING count(*) <> 1)",
    "unique_trial_cohorts": "SELECT count(*) FROM (SELECT k FROM sub GROUP BY k HAVING count(*) > 1)",
    "parent_graph_resolves": "SELECT abs((SELECT count(*) FROM cus) - (SELECT count(*) FROM who))",
    "parents_exist": "SELECT count(*) FROM who WHERE ultimate_parent NOT IN (SELECT customer FROM who)",
    "token_identity_and_allocation_complete": "SELECT abs((SELECT count(*) FROM tok) - (SELECT count(*) FROM tl))",
    "unique_token_allocation": "SELECT count(*) FROM (SELECT activity_id FROM tl GROUP BY activity_id HAVING count(*) <> 1)",
    "all_recognition_mapped": f"SELECT abs(count(*) - count(who.customer)) FROM {EARNED} e LEFT JOIN who USING (customer)",
    "meters_match_contracts": "SELECT count(*) FROM comp m WHERE row_kind = 'consumption' AND NOT EXISTS (SELECT 1 FROM site WHERE 'cap:' || r || ':' || site.purpose = m.capacity_id)",
    "unique_source_documents": """SELECT count(*) FROM (SELECT document FROM (SELECT 'i' || invoice_id AS document FROM inv UNION ALL SELECT 'c' || r || purpose FROM site UNION ALL SELECT 'm' || model FROM mdl)
        GROUP BY document HAVING count(*) > 1)""",
    "one_invoice_per_usage_batch": "SELECT count(*) FROM (SELECT batch FROM inv GROUP BY batch HAVING count(*) > 1)",
    "usage_batches_belong_to_one_customer": """SELECT count(*) FROM (SELECT batch FROM (SELECT batch, customer FROM tok UNION ALL SELECT batch, customer FROM inv) GROUP BY batch HAVING count(DISTINCT customer) > 1)""",
    "recognition_month": f"SELECT count(*) FROM {EARNED} WHERE month <> date_trunc('month', day)",
    "recognition_has_source_document": f"""SELECT count(*) FROM {EARNED} e WHERE NOT EXISTS (SELECT 1 FROM {DOCUMENTS} d
        WHERE d.kind = e.kind AND d.customer = e.customer AND d.document = e.document AND d.first <= e.day AND e.day < d.stop)""",
    "revenue_reconciles_by_month": f"""SELECT count(*) FROM (SELECT month, sum(cents) AS a FROM {EARNED} GROUP BY month)
        FULL JOIN (SELECT month, sum(cents) AS b FROM {EARNED} e JOIN who USING (customer) GROUP BY month) USING (month) WHERE coalesce(a, 0) <> coalesce(b, 0)""",
    "usage_allocations_reconcile": """SELECT count(*) FROM (SELECT batch, sum(net - fee) AS a FROM inv GROUP BY batch)
        FULL JOIN (SELECT usage_batch_id AS batch, sum(net_revenue_cents) AS b FROM tl GROUP BY batch) USING (batch) WHERE coalesce(a, 0) <> coalesce(b, 0)""",
    "inference_cost_allocations_reconcile": """SELECT count(*) FROM (SELECT month, model, sum(cost_cents) AS a FROM comp WHERE purpose = 'inference' GROUP BY ALL)
        FULL JOIN (SELECT month, model, sum(allocated_cost_cents) AS b FROM tl GROUP BY ALL) USING (month, model) WHERE coalesce(a, 0) <> coalesce(b, 0)""",
    "subscription_allocations_reconcile": f"""SELECT count(*) FROM {EARNED} e JOIN sl ON sl.subscription_id = e.document AND sl.month = e.month AND e.kind = 'subscription' WHERE e.cents <> sl.revenue_cents""",
    "seat_rollforward": "SELECT count(*) FROM sl WHERE beginning_seats + gross_adds - seat_removals - cancelled_seats + transfer_in - transfer_out <> ending_seats",
    "paid_state_has_start": """SELECT count(*) FROM ev e WHERE kind <> 'subscription_started' AND NOT EXISTS (
        SELECT 1 FROM ev s WHERE s.kind = 'subscription_started' AND s.sid = e.sid AND s.day <= e.day)""",
    "subscription_exposure_supported": """SELECT count(*) FROM state a WHERE seats > 0 AND day < stop AND EXISTS (SELECT 1 FROM state b
        WHERE b.customer = a.customer AND b.sid <> a.sid AND b.seats > 0 AND b.day < b.stop AND (b.day, b.sid) < (a.day, a.sid) AND b.stop > a.day)""",
    "recognized_subscription_has_exposure": f"""SELECT count(*) FROM sl JOIN {EARNED} e ON e.document = subscription_id AND e.month = sl.month AND e.kind = 'subscription' WHERE e.cents <> 0 AND seat_days = 0""",
    "invoice_recognition_fee_basis": f"""SELECT count(*) FROM inv JOIN (SELECT document, sum(cents) AS c FROM {EARNED} WHERE kind = 'usage' GROUP BY document) ON document = invoice_id
        WHERE c <> net - fee OR (fee > 0 AND net = fee)""",
}
#: Failures that one set of planted faults adds. Lost and doubled tokens of a set balance, so the population's count doesn't show them.
PLANTED_CLAIMS = {
    "unique_customer_creation": 1, "unique_trial_cohorts": 1, "parent_graph_resolves": 2, "parents_exist": 1, "unique_token_allocation": 1, "all_recognition_mapped": 1, "meters_match_contracts": 1,
    "unique_source_documents": 3, "one_invoice_per_usage_batch": 1, "usage_batches_belong_to_one_customer": 1, "recognition_month": 1, "recognition_has_source_document": 1,
    "usage_allocations_reconcile": 1, "inference_cost_allocations_reconcile": 1, "seat_rollforward": 1, "paid_state_has_start": 1, "subscription_exposure_supported": 1,
    "invoice_recognition_fee_basis": 1,
}
BROKEN_CLAIMS = {reason: f"({clean}) + {PLANTED_CLAIMS.get(reason, 0)} * {BAD}" for reason, clean in CLAIMS.items()}

COUNTERS = """WITH e AS (SELECT event_id, user_id, event_type, ts AT TIME ZONE 'UTC' AS ts, round(value * 100)::BIGINT AS v, event_type || '-' || user_id % 7 AS scope_id, 'u' || user_id % 40 AS account FROM events),
    f AS (SELECT *, sum(v) OVER (PARTITION BY account, scope_id ORDER BY ts, event_id)::BIGINT AS so_far,
        CASE WHEN event_id % 97 = 0 THEN 'other/v1' ELSE 'local-token-count/v1' END AS source FROM e),
    o AS (SELECT account, source, scope_id, 'input' AS token_kind, 'cumulative' AS temporality, ts, event_id AS source_line, CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 0 ELSE so_far END AS quantity FROM f
        UNION ALL SELECT account, source, scope_id, 'output', 'cumulative', ts, event_id, so_far // 3 FROM f
        UNION ALL SELECT account, source, scope_id, unnest(['input', 'output', 'total']), 'interval_total', ts, event_id, unnest([v * 3 // 4, v - v * 3 // 4, v + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END]) FROM f WHERE event_id % 11 = 0),
    obs AS (SELECT * FROM o WHERE source = 'local-token-count/v1'),
    g AS (SELECT *, lag(quantity) OVER w AS previous, lag(ts) OVER w AS previous_ts FROM obs WHERE temporality = 'cumulative' AND ts < TIMESTAMPTZ '2024-01-25 00:00:00+00'
        WINDOW w AS (PARTITION BY account, source, scope_id, token_kind ORDER BY ts, source_line)),
    steps AS (SELECT *, CASE WHEN previous_ts IS NULL THEN 'opening_balance' WHEN previous_ts < TIMESTAMPTZ '2024-01-10 00:00:00+00' THEN 'crosses_window_boundary'
            WHEN quantity IS NULL OR previous IS NULL THEN 'missing_counter' WHEN quantity < previous THEN 'counter_reset' ELSE 'observed' END AS status
        FROM g WHERE ts >= TIMESTAMPTZ '2024-01-10 00:00:00+00'),
    within AS (SELECT * FROM obs WHERE ts >= TIMESTAMPTZ '2024-01-10 00:00:00+00' AND ts < TIMESTAMPTZ '2024-01-25 00:00:00+00'),
    residual AS (SELECT account, scope_id, ts, source_line, max(quantity) FILTER (WHERE token_kind = 'total') AS total, max(quantity) FILTER (WHERE token_kind = 'input') AS input,
        max(quantity) FILTER (WHERE token_kind = 'output') AS output FROM within WHERE temporality = 'interval_total' GROUP BY account, scope_id, ts, source_line HAVING total <> input + output),
    listed AS (SELECT DISTINCT 'u' || user_id % 45 AS account FROM events),
    seen AS (SELECT account, max(ts) AS seen_at, max(ts) + INTERVAL 1 HOUR AS imported_at FROM within GROUP BY account),
    gaps AS (SELECT account, 'vendor' AS provider, s.surface, 'account' AS scope, 'surface_coverage' AS gap, '2024-01-02 00:00:00' AS verified_at,
            strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS latest_observed_at,
            CASE WHEN s.surface <> 'cli' OR imported_at IS NULL THEN 'Collect a permitted usage source for this confirmed surface'
                ELSE 'Observe remaining sessions; retain unknown opening, boundary and tail intervals' END AS next_action,
            CASE WHEN s.surface <> 'cli' OR imported_at IS NULL THEN 'unavailable'
                WHEN imported_at < TIMESTAMPTZ '2024-01-31 18:00:00+00' - INTERVAL 7 DAY THEN 'stale' ELSE 'partial' END AS status
        FROM listed CROSS JOIN (VALUES ('cli'), ('web')) s(surface) LEFT JOIN seen USING (account)
        UNION ALL SELECT account, 'vendor', 'all', t.scope, t.gap, NULL, NULL, t.todo, 'unavailable' FROM listed CROSS JOIN (VALUES
            ('account', 'account_total', 'Account-wide coverage and cross-session lineage are unresolved; do not sum session counters'),
            ('billing', 'billed_charges', 'Import an actual charge source; subscription fees and costs are not inferred from tokens')) t(scope, gap, todo)
        UNION ALL SELECT 'u' || user_id % 40, 'vendor', 'cli', 'q' || event_id, 'quarantined_source', strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), NULL, 'unreadable. inspect', 'quarantined'
            FROM events WHERE event_id % 1000 = 7 AND event_id % 3000 <> 7)
"""
#: Packets by account and week. Of a line that two packets differ on, the earlier one has the fault: it is the week before that changes a retry.
PACKETS = """WITH e AS (SELECT event_id AS line, 'u' || user_id % 40 AS account, event_type || '-u' || user_id % 40 || '-' || user_id % 7 AS session, round(value * 100)::BIGINT AS v,
        date_diff('day', DATE '2024-01-01', (ts AT TIME ZONE 'UTC' AT TIME ZONE 'UTC')::DATE) AS day FROM events),
    f AS (SELECT *, sum(v) OVER (PARTITION BY account, session ORDER BY line)::BIGINT AS so_far, unnest(CASE WHEN day % 7 < 2 AND day // 7 > 0 THEN [day // 7 - 1, day // 7] ELSE [day // 7] END) AS week FROM e),
    p AS (SELECT *, account || ':' || week AS packet, week <> day // 7 AND line % 400 = 0 AS odd FROM f),
    own AS (SELECT packet, CASE WHEN line = 0 THEN 'identity' WHEN line % 2000 = 1 THEN 'total' WHEN line % 2000 = 3 THEN 'part above whole' ELSE 'observed after collection' END AS reason
        FROM p WHERE line = 0 OR (line % 2000 = 1 AND line % 53 <> 0) OR (line % 2000 = 3 AND line % 53 <> 0) OR line % 2000 = 5),
    sound AS (SELECT DISTINCT account, week, packet FROM p WHERE packet NOT IN (SELECT packet FROM own)),
    clash AS (SELECT DISTINCT a.packet AS earlier, b.packet AS later FROM p a JOIN p b ON a.line = b.line AND a.week < b.week WHERE a.odd),
    w0 AS (SELECT packet FROM sound WHERE week = 0), w1 AS (SELECT packet FROM sound WHERE week = 1 AND packet NOT IN (SELECT later FROM clash JOIN w0 ON earlier = packet)),
    w2 AS (SELECT packet FROM sound WHERE week = 2 AND packet NOT IN (SELECT later FROM clash JOIN w1 ON earlier = packet)), w3 AS (SELECT packet FROM sound WHERE week = 3 AND packet NOT IN (SELECT later FROM clash JOIN w2 ON earlier = packet)),
    w4 AS (SELECT packet FROM sound WHERE week = 4 AND packet NOT IN (SELECT later FROM clash JOIN w3 ON earlier = packet)),
    taken AS (SELECT packet FROM w0 UNION ALL SELECT packet FROM w1 UNION ALL SELECT packet FROM w2 UNION ALL SELECT packet FROM w3 UNION ALL SELECT packet FROM w4),
    q AS (SELECT packet, string_agg(reason, ', ' ORDER BY reason) AS reasons FROM (SELECT DISTINCT packet, reason FROM own
            UNION SELECT DISTINCT later, 'contradicts a stored observation' FROM clash JOIN w0 ON earlier = packet
            UNION SELECT packet, 'contradicts an earlier packet' FROM sound WHERE packet NOT IN (SELECT packet FROM taken) AND packet NOT IN (SELECT later FROM clash JOIN w0 ON earlier = packet)) GROUP BY packet),
    k AS (SELECT p.*, row_number() OVER (PARTITION BY line ORDER BY week) AS r FROM p JOIN taken USING (packet)),
    a AS (SELECT *, so_far * 3 // 4 + odd::BIGINT AS inp, so_far - so_far * 3 // 4 AS outp FROM k WHERE r = 1),
    obs AS (SELECT account, session, line, packet, 'cumulative' AS temporality, unnest(['input', 'output', 'total', 'cache_read', 'reasoning_output']) AS token_kind,
            unnest([CASE WHEN line % 53 <> 0 THEN inp END, outp, so_far + (odd OR line % 2000 = 1)::BIGINT, CASE WHEN line % 2000 = 3 THEN so_far + 9 ELSE 0 END, NULL]) AS quantity FROM a
        UNION ALL SELECT account, session, line, packet, 'interval_total', unnest(['input', 'output', 'total', 'cache_read', 'reasoning_output']),
            unnest([v * 3 // 4, v - v * 3 // 4, v + (line % 29 = 0)::BIGINT, NULL, NULL]) FROM a WHERE line % 3 <> 0)
"""
USAGE = {
    "admitted_counters": PACKETS + "SELECT account, temporality, token_kind, count(*) AS n, count(quantity) AS known, sum(quantity)::BIGINT AS quantity, count(DISTINCT packet) AS packets FROM obs GROUP BY ALL",
    "admitted_residuals": PACKETS + "SELECT account, session AS scope_id, line AS source_line, 1::BIGINT AS residual FROM a WHERE line % 3 <> 0 AND line % 29 = 0",
    "quarantined_packets": PACKETS + "SELECT packet, reasons FROM q",
    "usage_observations": COUNTERS + "SELECT account, source, scope_id, token_kind, temporality, source_line, quantity FROM obs",
    "usage_intervals": COUNTERS + """SELECT account, scope_id, token_kind, source_line, quantity, previous, status, CASE WHEN status = 'observed' THEN quantity - previous END AS growth FROM steps""",
    "usage_tokens": COUNTERS + """SELECT account, source, scope_id, token_kind,
        CASE WHEN count(*) FILTER (WHERE status IN ('counter_reset', 'missing_counter')) = 0 THEN sum(CASE WHEN status = 'observed' THEN quantity - previous END)::BIGINT END AS observed_tokens,
        count(*) AS observations, count(*) FILTER (WHERE status = 'observed') AS measured_intervals, count(*) FILTER (WHERE status <> 'observed') AS excluded_intervals,
        CASE WHEN bool_or(status = 'counter_reset') THEN 'counter_reset_unknown' WHEN bool_or(status = 'missing_counter') THEN 'missing_counter_unknown'
            WHEN bool_or(status = 'observed') THEN 'partial_observed' ELSE 'insufficient_observations' END AS status FROM steps GROUP BY ALL""",
    "usage_gaps_v1": COUNTERS + "SELECT * FROM gaps",
    "usage_gaps": COUNTERS + """SELECT * FROM gaps UNION ALL
        SELECT account, 'vendor', 'cli', scope_id, 'last_counter_reconciliation', strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'),
            'Last-counter diagnostics do not reconcile and are excluded from usage totals; inspect the retained source', 'diagnostic_mismatch' FROM residual GROUP BY account, scope_id""",
    "counter_residuals": COUNTERS + "SELECT account, scope_id, source_line, total, input, output, total - input - output AS residual FROM residual",
    "locator_scores": COUNTERS + """SELECT part, count(*) AS observations, count(*) FILTER (WHERE wanted) AS expected_findings, count(*) FILTER (WHERE located) AS located_findings, count(*) FILTER (WHERE located AND NOT wanted) AS false_positives,
        count(*) FILTER (WHERE wanted AND NOT located) AS missed_findings, count(*) FILTER (WHERE wanted AND located AND source_line % 5 = 0) AS incorrect_values FROM (
        SELECT p.source_line, r.source_line IS NOT NULL AS wanted, (r.source_line IS NOT NULL AND p.source_line % 7 <> 0) OR p.source_line % 13 = 0 AS located,
            CASE WHEN list_sum(list_transform(range(1, 65), lambda k: strpos('0123456789abcdef', sha256(p.scope_id || ':' || p.source_line)[k]) - 1)) % 3 = 0 THEN 'held_out' ELSE 'development' END AS part
        FROM (SELECT DISTINCT scope_id, source_line FROM within WHERE temporality = 'interval_total' AND token_kind = 'total') p LEFT JOIN residual r ON r.scope_id = p.scope_id AND r.source_line = p.source_line) GROUP BY part""",
    "usage_readiness": """SELECT 'usage_observed' AS activity, 2 * count(*) + 3 * count(*) FILTER (WHERE event_id % 11 = 0) AS n FROM events
        UNION ALL SELECT 'application_inventory', 2 * count(DISTINCT user_id % 45) FROM events UNION ALL SELECT 'usage_coverage', count(*) FROM events WHERE event_id % 1000 = 7""",
}
#: The control that each check belongs to, of those that revenue and its close need.
GATES = {
    r: gate for gate, reasons in {
        "accounting": "duplicate_invoice duplicate_contract duplicate_credit duplicate_expiry invalid_invoice orphan_credit invalid_expiry nonmonthly_subscription",
        "core": "unique_customer_creation parent_graph_resolves parents_exist financial_customer_exists one_invoice_per_batch paid_state_has_start overlapping_subscriptions",
        "journal": "journals_balance recognized_equals_revenue_accounts",
    }.items() for r in reasons.split()
}


def printed(relation: str, columns: dict[str, str], also: str = "") -> str:
    """Count and digest of a relation by the common encoding of rows: columns by name, values after their length."""
    shown = {"double": "({c}::VARCHAR)::DECIMAL(38, 12)::VARCHAR", "plain": "{c}::VARCHAR"}
    parts = [shown[kind].format(c=c) for c, kind in sorted(columns.items())]
    text = " || ',' || ".join(f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts)
    lanes = [f"coalesce(sum(('0x' || h[{15 * k + 1} : {15 * k + 15}])::HUGEINT), 0)::VARCHAR" for k in range(4)]
    return f"SELECT count(*) AS row_count, sha256(concat_ws(':', count(*)::VARCHAR, {', '.join(lanes)})) AS fingerprint{also} FROM (SELECT *, sha256({text}) AS h FROM {relation})"


PLAIN = {
    "customer": "c_custkey c_name c_nationkey c_mktsegment c_acctbal:double", "nation": "n_nationkey n_name n_regionkey", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:double o_orderdate o_orderpriority",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:double", "region": "r_regionkey r_name", "supplier": "s_suppkey s_name s_nationkey s_acctbal:double",
}
COLUMNS = {t: {c.partition(":")[0]: c.partition(":")[2] or "plain" for c in names.split()} for t, names in PLAIN.items()}
IDS = """ids AS (SELECT 'use:' || event_id || ':cumulative:' || unnest(['input', 'output']) AS id, 'usage_observed' AS activity, NULL::VARCHAR AS link FROM events
    UNION ALL SELECT 'use:' || event_id || ':interval_total:' || unnest(['input', 'output', 'total']), 'usage_observed', NULL FROM events WHERE event_id % 11 = 0
    UNION ALL SELECT DISTINCT 'inv:u' || user_id % 45 || ':' || s.x, 'application_inventory', NULL FROM events, (VALUES ('cli'), ('web')) s(x)
    UNION ALL SELECT 'cov:' || event_id, 'usage_coverage', 'evidence:failures/x' FROM events WHERE event_id % 1000 = 7),
    pos AS (SELECT id AS activity_id, activity, link, row_number() OVER (ORDER BY id) AS _stream_position FROM ids)"""
BILLED_AS_KNOWN = """WITH billed AS (SELECT 'c' || o_custkey AS customer, 'i' || o_orderkey AS document, round(o_totalprice * 100)::BIGINT AS net,
    date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND + CASE WHEN o_orderkey % 18 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END >= TIMESTAMP '2001-06-15' AS fresh
    FROM orders WHERE o_orderdate < DATE '2001-08-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
CAPTURED = """WITH b AS (SELECT 'inv:' || o_orderkey AS id, o_orderkey AS o, date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    p AS (SELECT *, row_number() OVER (ORDER BY id) AS pos, o % 101 <> 0 AND o % 109 <> 0 AS there FROM b),
    x AS (SELECT * FROM p WHERE month < DATE '2001-07-01'),
    e AS (SELECT 'unexpected_activity' AS kind, id FROM x WHERE NOT there UNION ALL SELECT 'rejected', NULL FROM p WHERE o % 101 <> 0 AND o % 109 = 0
        UNION ALL SELECT 'rejected', 'early:' || id FROM p WHERE o % 127 = 0 UNION ALL SELECT 'conflict', id FROM p WHERE there AND o % 107 = 0
        UNION ALL SELECT 'missing_activity', 'new:' || id FROM x WHERE o % 113 = 0 UNION ALL SELECT 'altered_activity', id FROM x WHERE there AND o % 97 = 0
        UNION ALL SELECT 'altered_arrival', id FROM x WHERE there AND o % 89 = 0 UNION ALL SELECT 'not_pre_ingestion_evidence', id FROM x WHERE there AND pos <= 10
        UNION ALL SELECT 'partial_source_coverage', NULL)
"""
CHECK_ORACLE = USAGE | {
    "fingerprints": "\nUNION ALL ".join(f"SELECT '{t}' AS population, * FROM ({printed(t, COLUMNS[t])})" for t in sorted(PLAIN)),
    "input_manifest": f"WITH {IDS} " + printed(
        "(SELECT * FROM pos WHERE _stream_position <= (SELECT count(*) // 2 FROM ids))", dict.fromkeys(("activity_id", "activity", "link", "_stream_position"), "plain"),
        ", min(_stream_position) AS first_position, max(_stream_position) AS last_position, min(activity_id) AS first_id, max(activity_id) AS last_id",
    ),
    "export_restored": f"WITH {IDS} " + printed("pos", dict.fromkeys(("activity_id", "activity", "link", "_stream_position"), "plain")),
    # Planted rows of each kind and how many of them lack a field, have no seats or no amount.
    "catalogue_errors": f"""SELECT activity, (n + coalesce(more, 0) * b)::BIGINT AS n, (coalesce(wrong, 0) * b)::BIGINT AS refused FROM (
        SELECT 'customer_created' AS activity, count(*) AS n FROM customer UNION ALL SELECT 'customer_merged', count(*) FROM customer WHERE c_custkey % 50 = 7 AND c_custkey >= 57
        UNION ALL SELECT 'model_released', count(*) FROM region UNION ALL SELECT 'tokens_processed', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 'usage_invoiced', count(*) FROM {BILLED} UNION ALL SELECT 'credit_issued', count(*) FROM {BILLED} AND o_orderkey % 67 = 0
        UNION ALL SELECT 'contract_signed', 7 * count(*) FROM customer WHERE c_nationkey % 4 = 0 AND c_custkey % 3 = 0 UNION ALL SELECT 'contract_expired', 6 * count(*) FROM customer WHERE c_nationkey % 4 = 0 AND c_custkey % 3 = 0
        UNION ALL SELECT unnest(['trial_started', 'subscription_started', 'seat_added', 'subscription_upgraded']), count(*) FROM customer WHERE c_custkey % 4 = 1
        UNION ALL SELECT 'trial_expired', count(*) FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 3 = 0 UNION ALL SELECT 'trial_converted', count(*) FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 3 <> 0
        UNION ALL SELECT 'subscription_cancelled', count(*) FROM customer WHERE c_custkey % 4 = 1 AND c_custkey % 7 = 0
        UNION ALL SELECT 'capacity_contracted', 2 * count(*) FROM region UNION ALL SELECT 'capacity_energized', 6 * count(*) FROM region UNION ALL SELECT 'capacity_consumed', 2 * 79 * count(*) FROM region) t
        LEFT JOIN (VALUES ('customer_created', 8, 0), ('contract_signed', 4, 4), ('contract_expired', 3, 0), ('usage_invoiced', 6, 6), ('credit_issued', 3, 3), ('subscription_started', 5, 5), ('seat_added', 1, 1),
            ('trial_started', 2, 2), ('model_released', 2, 2), ('capacity_consumed', 2, 2), ('capacity_contracted', 2, 0), ('tokens_processed', 4, 4)) p(activity, more, wrong) USING (activity), (SELECT {BAD} AS b)
        WHERE n > 0""",
    "compare_tables": """SELECT count(*) FILTER (WHERE c_custkey % 13 = 0) AS only_left, count(*) FILTER (WHERE c_custkey % 19 = 0) AS only_right, count(*) FILTER (WHERE c_custkey % 23 = 0) AS repeated_left,
        count(*) FILTER (WHERE c_custkey % 17 = 0 AND c_custkey % 13 <> 0) AS repeated_right, count(*) FILTER (WHERE c_custkey % 13 <> 0 AND (c_custkey % 11 = 0 OR c_custkey % 7 = 0)) AS different FROM customer""",
    "table_differences": """SELECT * FROM (SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 13 = 0 THEN 'missing right' END, CASE WHEN c_custkey % 23 = 0 THEN 'repeated left' END,
            CASE WHEN c_custkey % 17 = 0 AND c_custkey % 13 <> 0 THEN 'repeated right' END,
            nullif(CASE WHEN c_custkey % 13 <> 0 THEN concat_ws(' ', CASE WHEN c_custkey % 7 = 0 THEN 'c_name' END, CASE WHEN c_custkey % 11 = 0 THEN 'c_acctbal' END) END, '')) AS reason FROM customer
        UNION ALL SELECT -c_custkey - 1, 'missing left' FROM customer WHERE c_custkey % 19 = 0) WHERE reason <> ''""",
    "restatement": BILLED_AS_KNOWN + """, e AS (SELECT customer, known, sum(net)::DOUBLE AS total, count(*)::DOUBLE AS bills, count(*) FILTER (WHERE net > 15000000)::DOUBLE / count(*) AS large_share
            FROM billed, (VALUES ('old'), ('new')) k(known) WHERE known = 'new' OR NOT fresh GROUP BY ALL),
        t AS (SELECT customer, known, unnest(['total', 'bills', 'large_share']) AS measure, unnest([total, bills, large_share]) AS value FROM e),
        m AS (SELECT customer, measure, a.value AS o, b.value AS n FROM (SELECT * FROM t WHERE known = 'old') a RIGHT JOIN (SELECT * FROM t WHERE known = 'new') b USING (customer, measure))
        SELECT customer, measure, round(o, 6) AS old_value, round(n, 6) AS new_value, round(CASE measure WHEN 'large_share' THEN 100 * (n - o) ELSE n - o END, 6) AS delta,
            CASE WHEN o IS NULL THEN 'added' ELSE 'changed' END AS change, CASE measure WHEN 'total' THEN 'cents' WHEN 'bills' THEN 'count' ELSE 'percentage points' END AS unit,
            CASE WHEN o IS NULL THEN 'unavailable_endpoint' ELSE 'defined' END AS delta_status FROM m WHERE o IS NULL OR abs(o - n) > 1e-11""",
    "canonical_payloads": sql(f"""SELECT 'cust:' || k AS activity_id, 'customer_created' AS activity, '{{"channel":"' || channel || '","country":"' || country || '","parent_customer":' ||
            CASE WHEN k % 5 = 4 THEN '"c' || (k // 5) || '"' ELSE 'null' END || ',"segment":"' || segment || '"}}' AS feature_json FROM cus
        UNION ALL SELECT activity_id, 'credit_issued', '{{"amount_usd":"' || {dollars('amount')} || '","credit_id":"' || credit_id || '","invoice_id":"' || invoice_id || '","period":"' || month || '","reason":"service"}}' FROM cred
        UNION ALL SELECT activity_id, 'usage_invoiced', '{{"cash_due_usd":"' || {dollars('net')} || '","channel":"' || channel || '","channel_fee_usd":"' || {dollars('fee')} || '","commit_applied_usd":"0.00","contract_id":' ||
            coalesce('"' || contract_id || '"', 'null') || ',"discount_usd":"0.00","gross_usd":"' || {dollars('net')} || '","invoice_id":"' || invoice_id || '","net_usd":"' || {dollars('net')} || '","period_end":"' || month_end ||
            '","period_start":"' || month || '","usage_batch_id":"' || batch || '"}}' FROM inv
        UNION ALL SELECT activity_id, kind, '{{"plan":"' || plan || '","seats":2,"seats_after":' || seats || ',"subscription_id":"' || sid || '"}}' FROM state WHERE kind = 'seat_added'
        UNION ALL SELECT activity_id, kind, '{{"plan":"' || plan || '","reason":"price","seats":' || seats_before || ',"subscription_id":"' || sid || '"}}' FROM state WHERE kind = 'subscription_cancelled'"""),
    "metric_pack": f"""SELECT 'consumption_nrr' AS metric, '{{"lens":"' || lens || '","month":"' || month || '"}}' AS dimensions, m.measure, m.value, m.unit,
            CASE WHEN status = 'defined' AND m.value IS NULL THEN 'undefined' ELSE status END AS status FROM (
        SELECT month, lens, status, unnest([{{'measure': 'cohort_customers', 'value': cohort_customers::VARCHAR, 'unit': 'count'}},
            {', '.join(f"{{'measure': '{c}_usd', 'value': ({c}_cents::DECIMAL(20,2) / 100)::DECIMAL(20,2)::VARCHAR, 'unit': 'USD'}}" for c in ("all_base", "base_revenue", "current_revenue", "expansion", "contraction", "churn"))},
            {', '.join(f"{{'measure': '{c}', 'value': {c}::DECIMAL(18,6)::VARCHAR, 'unit': 'ratio'}}" for c in ("nrr", "expansion_share", "contraction_share", "churn_share", "cohort_revenue_coverage"))}]) AS m
        FROM ({REPORTS}))""",
    "nrr_date_diagnostic": f"""WITH rep AS ({REPORTS}), held AS (
            SELECT 'whole' AS report, month, status, nrr FROM rep WHERE month = DATE '2001-07-31' UNION ALL SELECT 'early', month, status, nrr FROM rep WHERE month = DATE '1996-07-31'
            UNION ALL SELECT 'mixed', month, status, nrr FROM rep UNION ALL SELECT 'short', month, status, nrr FROM rep WHERE month = DATE '2001-07-31' AND lens <> 'base_t12m'),
        k AS (SELECT report, count(*) AS n, count(*) FILTER (WHERE status <> 'defined' OR nrr IS NULL) AS off, min(month) AS low FROM held GROUP BY report),
        m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders WHERE o_orderdate < DATE '2001-08-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AND NOT (o_orderkey % 18 = 0 AND date_trunc('month', o_orderdate) = DATE '2001-07-01')),
        q AS (SELECT x.*, (SELECT count(*) FROM held h WHERE h.report = x.report AND h.month = x.d) AS hits FROM (SELECT d, report, population FROM (SELECT DISTINCT unnest([m, last_day(m)]) AS d FROM m),
            (SELECT unnest(['whole', 'early', 'mixed', 'short', 'missing']) AS report), (SELECT unnest(['nrr', 'seats']) AS population)) x)
        SELECT report || ':' || population || ':' || d AS case_id, s AS status, CASE WHEN s = 'date_grain_mismatch' THEN low::VARCHAR END AS suggested_date, coalesce(n, 0) AS population_rows, hits AS selected_rows, coalesce(off, 0) AS unavailable_rows FROM (
            SELECT q.*, n, off, low, CASE WHEN population = 'seats' THEN 'unsupported_population' WHEN report = 'missing' THEN 'no_population' WHEN report = 'mixed' THEN 'ambiguous_population' WHEN report = 'short' THEN 'incomplete_population'
            WHEN hits > 0 THEN CASE WHEN off > 0 THEN 'selected_unavailable' ELSE 'selected' END WHEN d = date_trunc('month', low) THEN 'date_grain_mismatch' ELSE 'no_matching_date' END AS s FROM q LEFT JOIN k USING (report))""",
    "erp_bridge": sql("""SELECT month, account, source, sum(cents)::BIGINT AS ledger_cents, (sum(cents) + (month(month) = 3)::BIGINT)::BIGINT AS erp_cents, -(month(month) = 3)::BIGINT AS difference_cents FROM (
        SELECT month, CASE recognition_kind WHEN 'usage' THEN '4000' WHEN 'subscription' THEN '4010' WHEN 'commit_expiry' THEN '4020' ELSE '4090' END AS account, source, revenue_cents AS cents FROM rec
        UNION ALL SELECT month, '4000', 'usage', fee FROM fund WHERE fee <> 0) GROUP BY month, account, source"""),
    "metric_identities": sql("""SELECT 'nrr_identity' AS reason, (SELECT count(*) FROM (SELECT lens, sum(current_cents) AS c, sum(base_cents) AS b, sum(greatest(current_cents - base_cents, 0)) AS e, sum(greatest(base_cents - current_cents, 0)) AS d
            FROM mem3 WHERE in_cohort GROUP BY lens) WHERE c <> b + e - d) AS failures
        UNION ALL SELECT 'cohort_monotone', (SELECT count(*) FROM (SELECT quarter_end, count(*) FILTER (WHERE revenue_cents >= 10000000) AS a, count(*) FILTER (WHERE revenue_cents >= 100000000) AS b,
            count(*) FILTER (WHERE revenue_cents >= 1000000000) AS c FROM qr GROUP BY quarter_end) WHERE b > a OR c > b)
        UNION ALL SELECT 'doctored nrr_identity', (SELECT count(*) FROM lens3 WHERE lens = 'base_t12m')
        UNION ALL SELECT 'doctored cohort_monotone', (SELECT count(DISTINCT quarter_end) FROM qr)"""),
    "stream_append": """WITH a AS (SELECT event_id AS k, 'use:' || event_id || ':cumulative:input' AS id, event_id % 2 AS batch FROM events), p AS (SELECT *, row_number() OVER (ORDER BY batch, id) AS pos FROM a)
        SELECT batch::BIGINT AS batch, 'new' AS grade, count(*) AS n, min(pos) AS low, max(pos) AS high FROM p GROUP BY batch
        UNION ALL SELECT 2, 'conflict', count(*), NULL, NULL FROM events WHERE event_id % 100 = 0""",
    "stream_restatement": COUNTERS.rstrip() + """, r AS (SELECT account AS customer, source_line % 2 AS batch, coalesce(quantity, 0) AS q FROM o WHERE temporality = 'cumulative' AND token_kind = 'input'),
        s AS (SELECT customer, count(*) FILTER (WHERE batch = 0) AS n0, sum(q) FILTER (WHERE batch = 0) AS q0, count(*) AS n1, sum(q) AS q1, count(*) FILTER (WHERE batch = 1) AS m FROM r GROUP BY customer),
        t AS (SELECT 0::BIGINT AS batch, customer, unnest(['readings', 'mean']) AS measure, 'added' AS change, NULL::DOUBLE AS o, unnest([n0::DOUBLE, q0::DOUBLE / n0]) AS n FROM s WHERE n0 > 0
            UNION ALL SELECT 1, customer, unnest(['readings', 'mean']), CASE WHEN n0 > 0 THEN 'changed' ELSE 'added' END, unnest([CASE WHEN n0 > 0 THEN n0::DOUBLE END, q0::DOUBLE / nullif(n0, 0)]), unnest([n1::DOUBLE, q1::DOUBLE / n1]) FROM s WHERE m > 0)
        SELECT batch, customer, measure, change, round(o, 4) AS old_value, round(n, 4) AS new_value FROM t WHERE o IS NULL OR o <> n""",
    "stream_counter_growth": COUNTERS + """SELECT account, scope_id, token_kind, source_line, quantity, previous, status, CASE WHEN status = 'observed' THEN quantity - previous END AS growth FROM steps""",
    "capture_exceptions": CAPTURED + "SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM e GROUP BY kind",
    "capture_totals": CAPTURED + """SELECT 'sim:bills' AS source, strftime(month, '%Y-%m') AS month, 'usage_invoiced' AS activity, count(*) FILTER (WHERE there) + count(*) FILTER (WHERE o % 113 = 0) AS expected_count,
        count(*) AS actual_count, 0::BIGINT AS expected_cents, 0::BIGINT AS actual_cents FROM x GROUP BY month""",
    "published_outputs": sql(f"""SELECT 'clean' AS stream, 'fact_revenue' AS output, 'published' AS status, count(*) AS n, sum(revenue_cents)::BIGINT AS cents FROM rec
        UNION ALL SELECT 'clean', 'close_accounts', 'published', count(*), sum(cents)::BIGINT FROM (SELECT sum(amount_cents) AS cents FROM jl GROUP BY month, account)
        UNION ALL SELECT 'broken', 'all', g.gate || ': ' || c.reason, c.failures, 0 FROM ({counts({r: BROKEN[r] for r in BROKEN})}) c
        JOIN (SELECT unnest({[r for r in GATES]}) AS reason, unnest({list(GATES.values())}) AS gate) g USING (reason) WHERE c.failures <> 0"""),
    "data_controls": sql(counts(CLEAN)),
    "data_controls_broken": sql(counts(BROKEN)),
    "data_tests": sql(counts(TESTS)),
    "data_tests_broken": sql(counts(BROKEN_TESTS)),
    "attribution": sql("""SELECT customer, item, CASE WHEN n > 4 THEN 'unresolved_candidates' ELSE 'proven_minimum_group_set' END AS status, CASE WHEN n > 4 THEN '' ELSE documents END AS documents FROM (
        SELECT a.customer, i.item, n, CASE WHEN i.item = 'total' THEN all_documents ELSE top_document END AS documents FROM (
        SELECT customer, count(*) AS n, string_agg(document, ',' ORDER BY document) AS all_documents, arg_min(document, (-net, document)) AS top_document, max(net) AS top FROM billed WHERE fresh GROUP BY customer) a
        LEFT JOIN (SELECT customer, max(net) AS top FROM billed WHERE NOT fresh GROUP BY customer) b USING (customer), (VALUES ('total'), ('largest')) i(item) WHERE i.item = 'total' OR b.top IS NULL OR a.top > b.top)""").replace("WITH RECURSIVE ", """WITH RECURSIVE billed AS (SELECT 'c' || o_custkey AS customer, 'i' || o_orderkey AS document, round(o_totalprice * 100)::BIGINT AS net,
            date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND + CASE WHEN o_orderkey % 18 = 0 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END >= TIMESTAMP '2001-06-15' AS fresh
            FROM orders WHERE o_orderdate < DATE '2001-08-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)), """, 1),
    "incremental_projection": """WITH ids AS (SELECT 'use:' || event_id || ':cumulative:' || unnest(['input', 'output']) AS id, 'usage_observed' AS activity, TRUE AS scoped FROM events
        UNION ALL SELECT 'use:' || event_id || ':interval_total:' || unnest(['input', 'output', 'total']), 'usage_observed', TRUE FROM events WHERE event_id % 11 = 0
        UNION ALL SELECT DISTINCT 'inv:u' || user_id % 45 || ':' || s.x, 'application_inventory', FALSE FROM events, (VALUES ('cli'), ('web')) s(x)
        UNION ALL SELECT 'cov:' || event_id, 'usage_coverage', TRUE FROM events WHERE event_id % 1000 = 7),
        p AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM ids)
        SELECT (pos > (SELECT max(pos) // 2 FROM p))::BIGINT AS version, activity, count(*) AS n, count(*) FILTER (WHERE scoped) AS scoped, min(pos) AS low, max(pos) AS high FROM p GROUP BY ALL""",
    "asserted_checks": sql(counts(CLAIMS)),
    "asserted_checks_broken": sql(counts(BROKEN_CLAIMS)),
    "stream_checks": ASSERTED + counts(STREAM),
    "stream_checks_broken": counts(FAULTY),
    "revenue_ledger_asserted": sql("""SELECT 'rec:' || activity_id AS activity_id, customer, month, 'usage' AS source, 'usage' AS recognition_kind, invoice_id AS source_document, channel, net - fee AS revenue_cents FROM inv
        UNION ALL SELECT 'rec:' || activity_id, customer, month, 'usage', 'credit', credit_id, 'direct', -amount FROM cred
        UNION ALL SELECT 'rec:' || activity_id, customer, month, 'commit_drawdown', 'commit_expiry', contract_id, 'direct', 20000000 FROM ended"""),
    "stg_capacity_contracts": sql("""SELECT 'cap:' || r || ':' || purpose AS capacity_id, 'p' || r AS provider, 'r' || r AS region, purpose, mw::DOUBLE AS mw, (rate * 100)::BIGINT AS rate_cents,
        DATE '1995-01-01' AS service_start, DATE '2001-08-01' AS service_end FROM site"""),
    "stg_compute_meters": sql("""SELECT capacity_id, purpose, model, month, consumed::DOUBLE AS mwh FROM comp WHERE row_kind = 'consumption'"""),
    "subscription_occurrences": sql("""SELECT activity_id, row_number() OVER w AS activity_occurrence, lead(day) OVER w AS repeated_day FROM ev WINDOW w AS (PARTITION BY customer, kind ORDER BY day, activity_id)"""),
}
