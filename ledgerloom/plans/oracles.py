"""The same results in DuckDB SQL, straight from the star-schema tables: an independent formulation without the stream."""

from __future__ import annotations

CTES: dict[str, str] = {
    "cus": """SELECT c_custkey AS k, 'c' || c_custkey AS customer, c_mktsegment AS segment, n_name AS country,
        ['direct', 'aws_marketplace', 'gcp_marketplace', 'azure_marketplace'][c_nationkey % 4 + 1] AS channel
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "up": """SELECT customer, CASE WHEN k % 50 = 7 AND k >= 57 THEN 'c' || (k - 50) WHEN k % 5 = 4 THEN 'c' || (k // 5) END AS parent FROM cus""",
    "climb(customer, node)": """SELECT customer, customer FROM up UNION ALL SELECT climb.customer, up.parent FROM climb JOIN up ON up.customer = climb.node WHERE up.parent IS NOT NULL""",
    "who": """SELECT cus.customer, segment, cus.channel, country, climb.node AS ultimate_parent FROM cus JOIN climb USING (customer) JOIN up ON up.customer = climb.node WHERE up.parent IS NULL""",
    "mdl": """SELECT 'g' || (r_regionkey + 1) AS model, (r_regionkey + 1)::INT AS generation, (DATE '1995-01-01' + to_months((12 * r_regionkey)::INT))::DATE AS release_date FROM region""",
    "cal": """SELECT (DATE '1995-01-01' + to_months(i::INT))::DATE AS month, (DATE '1995-01-01' + to_months(i::INT + 1))::DATE AS month_end FROM range(79) t(i)""",
    "calendar": """SELECT month, month_end, date_diff('day', month, month_end)::BIGINT AS days FROM cal""",
    "ord": """SELECT o_orderkey AS o, o_custkey AS k, 'c' || o_custkey AS customer, date_trunc('month', o_orderdate)::DATE AS month, round(o_totalprice * 100)::BIGINT AS net FROM orders WHERE o_orderdate < DATE '2001-08-01'""",
    "tok0": """SELECT 'tok:' || l_orderkey || ':' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS activity_id,
        'b' || o AS batch, ord.customer, ord.month, 'g' || least(5, year(ord.month) - 1994) AS model, ['input', 'output', 'cache_read', 'cache_write'][l_linenumber % 4 + 1] AS token_type, cus.channel,
        ['api', 'batch', 'agent'][(l_suppkey % 3 + 1)::INT] AS workload, (l_quantity * 100000)::BIGINT AS tokens, (round(l_extendedprice * 100)::BIGINT % 5000) / 100.0::DOUBLE AS price
        FROM lineitem JOIN ord ON o = l_orderkey JOIN cus ON cus.k = ord.k""",
    "tok": """SELECT *, greatest(0, round(tokens::DOUBLE * price / 10000)::BIGINT) AS rated FROM tok0""",
    "inv": """SELECT 'inv:' || o AS activity_id, 'i' || o AS invoice_id, 'b' || o AS batch, ord.customer, month, (month + to_months(1))::DATE AS month_end, net, CASE WHEN channel <> 'direct' THEN net * 5 // 100 ELSE 0 END AS fee,
        channel, CASE WHEN channel = 'direct' AND ord.k % 3 = 0 THEN 'k' || ord.k || ':' || year(month) END AS contract_id, o
        FROM ord JOIN cus ON cus.k = ord.k WHERE o IN (SELECT l_orderkey FROM lineitem) AND NOT (o % 18 = 0 AND month = DATE '2001-07-01')""",
    "con": """SELECT 'con:' || k || ':' || y AS activity_id, customer, 'k' || k || ':' || y AS contract_id, channel, make_date(y::BIGINT, 1, 1) AS first, make_date(y::BIGINT + 1, 1, 1) AS stop, y FROM cus, range(1995, 2002) t(y) WHERE channel = 'direct' AND k % 3 = 0""",
    "fund": """SELECT inv.*, CASE WHEN inv.contract_id IS NULL THEN 0 ELSE least(net, greatest(20000000 - (sum(net) OVER (PARTITION BY inv.contract_id ORDER BY month, inv.activity_id) - net), 0)) END::BIGINT AS draw FROM inv""",
    "ended": """SELECT 'exp:' || substr(contract_id, 2) AS activity_id, con.customer, contract_id, channel, con.activity_id AS contract_activity, stop AS month,
        (20000000 - coalesce((SELECT sum(draw) FROM fund WHERE fund.contract_id = con.contract_id), 0))::BIGINT AS amount FROM con WHERE y <= 2000""",
    "cred": """SELECT 'cred:' || ord.o AS activity_id, 'cr' || ord.o AS credit_id, 'i' || ord.o AS invoice_id, ord.customer, ord.month, cus.channel, ord.net * 5 // 100 AS amount,
        'inv:' || ord.o AS invoice_activity FROM ord JOIN cus ON cus.k = ord.k WHERE ord.o % 67 = 0 AND ord.o IN (SELECT l_orderkey FROM lineitem) AND ord.month < DATE '2001-07-01'""",
    "sub": """SELECT k, customer, (DATE '1995-01-01' + to_months((k % 24)::INT))::DATE AS s, 1 + k % 9 AS seats, (k // 4 % 4)::INT AS p FROM cus WHERE k % 4 = 1""",
    "ev": """SELECT 'sub:' || k AS activity_id, customer, 's' || k AS sid, 'subscription_started' AS kind, s + 14 AS day, p, seats, [20, 60, 35, 80][p + 1] * 100 AS price, 0 AS rank FROM sub
        UNION ALL SELECT 'seat:' || k, customer, 's' || k, 'seat_added', (s + to_months(5))::DATE, p, seats + 2, [20, 60, 35, 80][p + 1] * 100, 20 FROM sub
        UNION ALL SELECT 'up:' || k, customer, 's' || k, 'subscription_upgraded', (s + to_months(8))::DATE, (p + 1) % 4, seats + 2, [20, 60, 35, 80][(p + 1) % 4 + 1] * 100, 10 FROM sub
        UNION ALL SELECT 'cancel:' || k, customer, 's' || k, 'subscription_cancelled', (s + to_months(30))::DATE, (p + 1) % 4, 0, [20, 60, 35, 80][(p + 1) % 4 + 1] * 100, 30 FROM sub WHERE k % 7 = 0""",
    "state": """SELECT *, ['pro', 'max', 'team', 'enterprise'][p + 1] AS plan, coalesce(lead(day) OVER w, DATE '2001-08-01') AS stop, coalesce(lag(seats) OVER w, 0) AS seats_before,
        coalesce(lag(['pro', 'max', 'team', 'enterprise'][p + 1]) OVER w, ['pro', 'max', 'team', 'enterprise'][p + 1]) AS plan_before FROM ev WINDOW w AS (PARTITION BY sid ORDER BY day, rank)""",
    "submonth": """SELECT customer, sid, month, sum(price * seats * date_diff('day', greatest(day, month), least(stop, month_end)))::BIGINT AS numerator, max(date_diff('day', month, month_end))::BIGINT AS days,
        list_sort(list(DISTINCT activity_id)) AS ids FROM state JOIN cal ON day < month_end AND stop > month GROUP BY ALL""",
    "subamount": """SELECT 'subscription:' || sid || ':' || month AS activity_id, *, ((2 * numerator + days) // (2 * days))::BIGINT AS amount FROM submonth""",
    "line": """SELECT activity_id, customer, month, 'commit_drawdown' AS source, 'usage' AS recognition_kind, invoice_id AS source_document, channel, draw AS revenue_cents,
            CASE WHEN contract_id IS NULL THEN activity_id ELSE 'con:' || substr(contract_id, 2) || ',' || activity_id END AS upstream FROM fund
        UNION ALL SELECT activity_id, customer, month, 'usage', 'usage', invoice_id, channel, net - fee - draw, CASE WHEN contract_id IS NULL THEN activity_id ELSE 'con:' || substr(contract_id, 2) || ',' || activity_id END FROM fund
        UNION ALL SELECT activity_id, customer, month, 'commit_drawdown', 'commit_expiry', contract_id, channel, amount, contract_activity || ',' || activity_id FROM ended
        UNION ALL SELECT activity_id, customer, month, 'usage', 'credit', credit_id, channel, -amount, activity_id || ',' || invoice_activity FROM cred
        UNION ALL SELECT activity_id, customer, month, 'subscription', 'subscription', sid, 'direct', amount, array_to_string(ids, ',') FROM subamount""",
    "rec": """SELECT activity_id || ':' || source || ':' || recognition_kind || ':' || month AS activity_id, customer, month, source, recognition_kind, source_document, channel, revenue_cents, upstream FROM line WHERE revenue_cents <> 0""",
    "fam": """SELECT rec.*, CASE WHEN recognition_kind = 'usage' THEN 'consumption' ELSE recognition_kind END AS family FROM rec""",
    "jr": """SELECT activity_id, customer, date_trunc('month', first)::DATE AS month, unnest(['1100', '2100']) AS account, unnest([20000000, -20000000]) AS amount_cents FROM con
        UNION ALL SELECT activity_id, customer, month, unnest(['2100', '1100', '4000', '4095']), unnest([draw, net - draw - fee, -net, fee]) FROM fund
        UNION ALL SELECT activity_id, customer, month, unnest(['2100', '4020']), unnest([amount, -amount]) FROM ended
        UNION ALL SELECT activity_id, customer, month, unnest(['4090', '1100']), unnest([amount, -amount]) FROM cred
        UNION ALL SELECT activity_id, customer, month, unnest(['1100', '4010']), unnest([amount, -amount]) FROM subamount""",
    "jl": """SELECT activity_id, customer, month, account, amount_cents::BIGINT AS amount_cents FROM jr WHERE amount_cents <> 0""",
    "site": """SELECT r_regionkey AS r, u.p AS purpose, (r_regionkey + 1) * CASE WHEN u.p = 'inference' THEN 10 ELSE 5 END AS mw, 50 + 5 * r_regionkey AS rate FROM region, (VALUES ('inference'), ('training')) u(p)""",
    "comp": """SELECT 'capacity' AS row_kind, 'cap:' || r || ':' || purpose AS activity_id, 'cap:' || r || ':' || purpose AS capacity_id, month, 'p' || r AS provider, 'r' || r AS region, purpose, NULL::VARCHAR AS model,
            mw::DOUBLE * 24 * date_diff('day', month, month_end) AS contracted, mw::DOUBLE * 24 * date_diff('day', month, month_end) * CASE WHEN month < DATE '1995-07-01' THEN 0.35 WHEN month < DATE '1996-01-01' THEN 0.7 ELSE 1 END AS energized, 0::DOUBLE AS consumed, 0::BIGINT AS cost_cents FROM site, cal
        UNION ALL SELECT 'consumption', 'use:' || r || ':' || purpose || ':' || month, 'cap:' || r || ':' || purpose, month, 'p' || r, 'r' || r, purpose, 'g' || least(5, year(month) - 1994), 0::DOUBLE, 0::DOUBLE, mw::DOUBLE * 12 * date_diff('day', month, month_end), (mw * 12 * date_diff('day', month, month_end) * rate * 100)::BIGINT FROM site, cal""",
    "w": """SELECT tok.*, tokens::HUGEINT * CASE token_type WHEN 'input' THEN 20000000 WHEN 'output' THEN 80000000 WHEN 'cache_read' THEN 3000000 ELSE 25000000 END * (4 ** (substr(model, 2)::INT - 1))::BIGINT // (5 ** (substr(model, 2)::INT - 1))::BIGINT AS energy,
        coalesce((SELECT sum(revenue_cents) FROM rec WHERE rec.recognition_kind = 'usage' AND rec.source_document = 'i' || substr(tok.batch, 2) AND rec.month = tok.month), 0)::HUGEINT AS rev,
        coalesce((SELECT fee FROM fund WHERE fund.batch = tok.batch), 0)::HUGEINT AS fee, coalesce((SELECT sum(cost_cents) FROM comp WHERE comp.purpose = 'inference' AND comp.model = tok.model AND comp.month = tok.month), 0)::HUGEINT AS cost FROM tok""",
    "w2": """SELECT *, CASE WHEN sum(rated) OVER b > 0 THEN rated ELSE tokens END::HUGEINT AS rw, sum(energy) OVER (PARTITION BY month, model)::HUGEINT AS te FROM w WINDOW b AS (PARTITION BY batch, month)""",
    "w3": """SELECT *, sum(rw) OVER (PARTITION BY batch, month)::HUGEINT AS tw FROM w2""",
    "w4": """SELECT *, row_number() OVER (PARTITION BY batch, month ORDER BY rev * rw % tw DESC, activity_id) AS rk, row_number() OVER (PARTITION BY batch, month ORDER BY fee * rw % tw DESC, activity_id) AS fk,
        row_number() OVER (PARTITION BY month, model ORDER BY cost * energy % te DESC, activity_id) AS ck FROM w3""",
    "tl": """SELECT w4.activity_id, w4.customer, w4.month, w4.model, mdl.generation, mdl.release_date, token_type, w4.channel, workload, who.segment, who.ultimate_parent, batch AS usage_batch_id, tokens, energy::DOUBLE AS energy_weight,
        (rev * rw // tw + CASE WHEN rk <= rev - sum(rev * rw // tw) OVER (PARTITION BY batch, w4.month) THEN 1 ELSE 0 END)::BIGINT AS net_revenue_cents,
        (fee * rw // tw + CASE WHEN fk <= fee - sum(fee * rw // tw) OVER (PARTITION BY batch, w4.month) THEN 1 ELSE 0 END)::BIGINT AS channel_fee_cents,
        (cost * energy // te + CASE WHEN ck <= cost - sum(cost * energy // te) OVER (PARTITION BY w4.month, w4.model) THEN 1 ELSE 0 END)::BIGINT AS allocated_cost_cents
        FROM w4 JOIN mdl ON mdl.model = w4.model JOIN who ON who.customer = w4.customer""",
    "mix": """SELECT batch, CASE WHEN count(DISTINCT model) = 1 THEN min(model) ELSE 'unallocated' END AS model, CASE WHEN count(DISTINCT workload) = 1 THEN min(workload) ELSE 'unallocated' END AS workload FROM tok GROUP BY batch""",
    "rl": """SELECT fam.activity_id, fam.customer, fam.month, fam.source, fam.recognition_kind, fam.source_document, fam.channel, fam.revenue_cents, fam.family, who.segment, who.ultimate_parent, inv.batch AS usage_batch_id,
        coalesce(mix.model, 'unallocated') AS model, coalesce(mix.workload, 'unallocated') AS workload FROM fam JOIN who USING (customer)
        LEFT JOIN inv ON inv.invoice_id = CASE fam.recognition_kind WHEN 'credit' THEN 'i' || substr(fam.source_document, 3) WHEN 'usage' THEN fam.source_document END LEFT JOIN mix ON mix.batch = inv.batch""",
    "pm": """SELECT ultimate_parent, month, sum(CASE WHEN family = 'consumption' THEN revenue_cents ELSE 0 END)::BIGINT AS consumption_cents, sum(CASE WHEN family = 'subscription' THEN revenue_cents ELSE 0 END)::BIGINT AS subscription_cents,
        sum(revenue_cents)::BIGINT AS net_revenue_cents FROM fam JOIN who USING (customer) GROUP BY ALL""",
    "expo": """SELECT customer, sid, plan, month, sum(CASE WHEN day < month AND stop >= month THEN seats ELSE 0 END)::BIGINT AS beginning_seats, sum(CASE WHEN stop >= month_end THEN seats ELSE 0 END)::BIGINT AS ending_seats,
        sum(CASE WHEN stop > month THEN seats * date_diff('day', greatest(day, month), least(stop, month_end)) ELSE 0 END)::BIGINT AS seat_days,
        sum(CASE WHEN stop > month AND seats > 0 THEN date_diff('day', greatest(day, month), least(stop, month_end)) ELSE 0 END)::BIGINT AS account_days,
        sum(CASE WHEN stop > month THEN price * seats * date_diff('day', greatest(day, month), least(stop, month_end)) ELSE 0 END)::HUGEINT AS x FROM state JOIN cal ON day < month_end AND stop >= month GROUP BY ALL""",
    "move": """SELECT customer, sid, plan, date_trunc('month', day)::DATE AS month, greatest(seats - seats_before, 0) AS ga, CASE WHEN rank = 30 THEN 0 ELSE greatest(seats_before - seats, 0) END AS sr, CASE WHEN rank = 30 THEN seats_before ELSE 0 END AS cs,
            CASE WHEN plan <> plan_before THEN seats_before ELSE 0 END AS ti, 0 AS tout, 0 AS ua FROM state
        UNION ALL SELECT customer, sid, plan_before, date_trunc('month', day)::DATE, 0, 0, 0, 0, CASE WHEN plan <> plan_before THEN seats_before ELSE 0 END, CASE WHEN rank = 10 THEN 1 ELSE 0 END FROM state WHERE plan <> plan_before OR rank = 10""",
    "flow": """SELECT customer, sid, plan, month, sum(ga)::BIGINT AS gross_adds, sum(sr)::BIGINT AS seat_removals, sum(cs)::BIGINT AS cancelled_seats, sum(ti)::BIGINT AS transfer_in, sum(tout)::BIGINT AS transfer_out, max(ua)::BIGINT AS upgraded_account FROM move GROUP BY ALL""",
    "seat0": """SELECT customer, sid, plan, month, coalesce(beginning_seats, 0) AS beginning_seats, coalesce(ending_seats, 0) AS ending_seats, coalesce(seat_days, 0) AS seat_days, coalesce(account_days, 0) AS account_days,
        coalesce(gross_adds, 0) AS gross_adds, coalesce(seat_removals, 0) AS seat_removals, coalesce(cancelled_seats, 0) AS cancelled_seats, coalesce(transfer_in, 0) AS transfer_in, coalesce(transfer_out, 0) AS transfer_out,
        coalesce(upgraded_account, 0) AS upgraded_account, 0::BIGINT AS downgraded_account, coalesce(x, 0) AS x FROM expo FULL JOIN flow USING (customer, sid, plan, month)""",
    "seat1": """SELECT seat0.*, coalesce(a.amount, 0)::HUGEINT AS amount, sum(x) OVER (PARTITION BY seat0.sid, seat0.month)::HUGEINT AS tx FROM seat0 LEFT JOIN subamount a ON a.sid = seat0.sid AND a.month = seat0.month WHERE seat0.month < DATE '2001-08-01'""",
    "seat2": """SELECT *, row_number() OVER (PARTITION BY sid, month ORDER BY amount * x % nullif(tx, 0) DESC NULLS LAST, plan) AS rk FROM seat1""",
    "sl": """SELECT customer, sid AS subscription_id, plan, month, date_diff('day', month, (month + to_months(1))::DATE)::BIGINT AS days, beginning_seats, ending_seats, seat_days, account_days, gross_adds, seat_removals, cancelled_seats, transfer_in, transfer_out, upgraded_account, downgraded_account,
        coalesce(amount * x // nullif(tx, 0) + CASE WHEN rk <= amount - sum(amount * x // nullif(tx, 0)) OVER (PARTITION BY sid, month) THEN 1 ELSE 0 END, 0)::BIGINT AS revenue_cents FROM seat2""",
    "tr": """SELECT s AS month, ['pro', 'max', 'team', 'enterprise'][p + 1] AS plan, count(*) AS trials_started, count(*) FILTER (WHERE k % 3 <> 0) AS trial_cohort_converted, count(*) AS trial_cohort_resolved FROM sub GROUP BY ALL""",
    "lens3": """SELECT * FROM (VALUES ('base_t12m', 12, 1, FALSE, 10000000), ('floor_100k', 12, 1, FALSE, 10000000), ('t3m_annualized', 3, 4, FALSE, 1000000), ('subscription_inclusive', 12, 1, TRUE, 1000000)) v(lens, n, times, subs, floor)""",
    "mem": """SELECT lens, u.ultimate_parent, coalesce(sum(CASE WHEN month >= DATE '2000-08-01' - to_months(n) AND month < DATE '2000-08-01' THEN consumption_cents + CASE WHEN subs THEN subscription_cents ELSE 0 END END), 0)::BIGINT AS base_cents,
        coalesce(sum(CASE WHEN month >= DATE '2001-08-01' - to_months(n) THEN consumption_cents + CASE WHEN subs THEN subscription_cents ELSE 0 END END), 0)::BIGINT AS current_cents, any_value(times) AS times, any_value(floor) AS floor
        FROM lens3, (SELECT DISTINCT ultimate_parent FROM who) u LEFT JOIN pm ON pm.ultimate_parent = u.ultimate_parent GROUP BY lens, u.ultimate_parent""",
    "mem3": """SELECT lens, ultimate_parent, base_cents, current_cents, base_cents * times >= floor AS in_cohort FROM mem""",
    "mem2": """SELECT lens, ultimate_parent, base_cents, current_cents, base_cents * times >= CASE lens WHEN 'floor_100k' THEN 10000000 ELSE 1000000 END AS in_cohort FROM mem""",
    "late": """SELECT ord.o, ord.net, CASE WHEN channel <> 'direct' THEN ord.net * 5 // 100 ELSE 0 END AS fee, CASE WHEN channel = 'direct' AND ord.k % 3 = 0 THEN 'k' || ord.k || ':2001' END AS contract_id
        FROM ord JOIN cus ON cus.k = ord.k WHERE ord.o % 18 = 0 AND month = DATE '2001-07-01' AND ord.o IN (SELECT l_orderkey FROM lineitem)""",
    "qr": """SELECT (q.month_end - 1)::DATE AS quarter_end, ultimate_parent, sum(net_revenue_cents)::BIGINT AS revenue_cents FROM cal q JOIN pm ON pm.month < q.month_end AND pm.month >= q.month_end - to_months(12)
        WHERE month(q.month) % 3 = 0 AND q.month_end >= DATE '1996-01-01' GROUP BY ALL""",
    "th": """SELECT unnest([10000000, 100000000, 1000000000])::BIGINT AS threshold_cents""",
}


def sql(final: str) -> str:
    """A query over the common tables; DuckDB runs only those it uses."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in CTES.items()) + "\n" + final


def per_mtok(cut: str) -> str:
    return sql(f"""SELECT month, {cut}, sum(tokens)::BIGINT AS tokens, sum(net_revenue_cents)::BIGINT AS net_revenue_cents, sum(channel_fee_cents)::BIGINT AS channel_fee_cents, sum(net_revenue_cents + channel_fee_cents)::BIGINT AS revenue_before_channel_fees_cents,
        sum(net_revenue_cents) * 10000.0::DOUBLE / sum(tokens) AS net_of_discounts_and_fees_per_mtok, sum(net_revenue_cents + channel_fee_cents) * 10000.0::DOUBLE / sum(tokens) AS net_of_discounts_per_mtok FROM tl GROUP BY ALL""")

def nrr(members: str, shares_always: bool = False) -> str:
    """Retention by lens with its status; shares are shown without history only in the first version."""
    share = "b" if shares_always else "CASE WHEN status = 'defined' THEN b END"
    return sql(f"""SELECT DATE '2001-07-31' AS month, lens, status, cohort_customers, ab AS all_base_cents, b AS base_revenue_cents, c AS current_revenue_cents,
        e AS expansion_cents, d AS contraction_cents, g AS churn_cents, CASE WHEN status = 'defined' THEN c::DOUBLE / nullif(b, 0) END AS nrr,
        e::DOUBLE / nullif({share}, 0) AS expansion_share, d::DOUBLE / nullif({share}, 0) AS contraction_share, g::DOUBLE / nullif({share}, 0) AS churn_share,
        ({share})::DOUBLE / nullif(ab, 0) AS cohort_revenue_coverage FROM (
        SELECT *, CASE WHEN DATE '1995-01-01' > DATE '2000-08-01' - to_months(n) THEN 'insufficient_history' WHEN b = 0 THEN 'undefined_zero_base' ELSE 'defined' END AS status FROM (
        SELECT lens, count(*) FILTER (WHERE in_cohort) AS cohort_customers, sum(base_cents)::BIGINT AS ab, coalesce(sum(base_cents) FILTER (WHERE in_cohort), 0)::BIGINT AS b,
        coalesce(sum(current_cents) FILTER (WHERE in_cohort), 0)::BIGINT AS c, coalesce(sum(greatest(current_cents - base_cents, 0)) FILTER (WHERE in_cohort), 0)::BIGINT AS e,
        coalesce(sum(base_cents - current_cents) FILTER (WHERE in_cohort AND current_cents <> 0 AND base_cents > current_cents), 0)::BIGINT AS d,
        coalesce(sum(base_cents) FILTER (WHERE in_cohort AND current_cents = 0), 0)::BIGINT AS g FROM {members} GROUP BY lens) JOIN lens3 USING (lens))""")


def early(query: str) -> str:
    """The same as of July 1996: five years less, without the mergers of 1999."""
    later = "WHEN k % 50 = 7 AND k >= 57 THEN 'c' || (k - 50) "
    members = """SELECT l.lens, u.ultimate_parent, coalesce(sum(cents) FILTER (WHERE past), 0)::BIGINT AS base_cents, coalesce(sum(cents) FILTER (WHERE NOT past), 0)::BIGINT AS current_cents,
        any_value(l.times) AS times, any_value(l.floor) AS floor FROM lens3 l CROSS JOIN (SELECT DISTINCT ultimate_parent FROM who) u LEFT JOIN (
        SELECT lens, ultimate_parent, month < DATE '2000-08-01' AS past, sum(consumption_cents + CASE WHEN subs THEN subscription_cents ELSE 0 END)::BIGINT AS cents FROM pm, lens3
        WHERE (month < DATE '2000-08-01' AND month >= DATE '2000-08-01' - to_months(n)) OR month >= DATE '2001-08-01' - to_months(n) GROUP BY ALL) s
        ON s.lens = l.lens AND s.ultimate_parent = u.ultimate_parent GROUP BY ALL"""
    moved = query.replace(CTES["mem"], members).replace(later, "").replace("FROM ev WINDOW", "FROM ev WHERE day < DATE '2001-08-01' WINDOW").replace("range(79)", "range(19)").replace("range(1995, 2002)", "range(1995, 1997)").replace("y <= 2000", "y <= 1995")
    for day in ("-07-01", "-07-31", "-08-01"):
        moved = moved.replace(f"2000{day}", f"1995{day}").replace(f"2001{day}", f"1996{day}")
    return moved


ORACLE: dict[str, str] = {
    "net_rev_per_mtok": per_mtok("model"),
    "net_rev_per_mtok_segment": per_mtok("segment, channel"),
    "fact_revenue": sql("SELECT activity_id, customer, month, source, recognition_kind, source_document, channel, revenue_cents::BIGINT AS revenue_cents, upstream FROM rec"),
    "journal_lines": sql("SELECT * FROM jl"),
    "close_accounts": sql("SELECT month, account, sum(amount_cents)::BIGINT AS amount_cents FROM jl GROUP BY ALL"),
    "close_rollforward": sql("""SELECT month, account, m::BIGINT AS movement_cents, (sum(m) OVER w - m)::BIGINT AS beginning_cents, (sum(m) OVER w)::BIGINT AS ending_cents FROM (
        SELECT cal.month, a.account, coalesce(sum(amount_cents), 0) AS m FROM cal CROSS JOIN (SELECT DISTINCT account FROM jl) a LEFT JOIN jl ON jl.month = cal.month AND jl.account = a.account GROUP BY ALL) WINDOW w AS (PARTITION BY account ORDER BY month)"""),
    "customer_identity": sql("SELECT * FROM who"),
    "parent_month": sql("SELECT * FROM pm"),
    "calendar": sql("SELECT * FROM calendar"),
    "funding": sql("SELECT activity_id, contract_id, net AS net_cents, fee::BIGINT AS fee_cents, draw AS draw_cents FROM fund"),
    "expiry_amounts": sql("SELECT activity_id, contract_id, month, amount FROM ended"),
    "credit_amounts": sql("SELECT activity_id, invoice_id, invoice_activity, channel, amount FROM cred"),
    "subscription_amounts": sql("SELECT activity_id, customer, month, numerator::DOUBLE AS numerator, days, amount FROM subamount"),
    "subscription_states": sql("SELECT activity_id, sid AS subscription_id, plan, day AS start_day, stop AS stop_day, price::BIGINT AS price_cents, seats::BIGINT AS paid_seats FROM state"),
    "revenue_ledger": sql("SELECT activity_id, customer, month, family, segment, ultimate_parent, usage_batch_id, model, workload, revenue_cents::BIGINT AS revenue_cents FROM rl"),
    "compute_ledger": sql("SELECT row_kind, activity_id, capacity_id, month, provider, region, purpose, model, contracted::DOUBLE AS contracted_mwh_capacity, energized::DOUBLE AS energized_mwh_capacity, consumed::DOUBLE AS consumed_mwh, cost_cents FROM comp"),
    "token_ledger": sql("SELECT * FROM tl"),
    "seat_ledger": sql("SELECT * FROM sl"),
    "trial_cohorts": sql("SELECT * FROM tr"),
    "cost_per_mtok": sql("""SELECT month, model, sum(tokens)::BIGINT AS tokens, sum(allocated_cost_cents)::BIGINT AS allocated_inference_cost_cents, sum(net_revenue_cents)::BIGINT AS net_revenue_cents,
        sum(allocated_cost_cents) * 10000.0::DOUBLE / sum(tokens) AS cost_per_mtok, 1 - sum(allocated_cost_cents)::DOUBLE / nullif(sum(net_revenue_cents), 0) AS inference_gross_margin FROM tl GROUP BY ALL"""),
    "rev_per_mw": sql("""SELECT DATE '2001-07-31' AS month, purpose, 'defined' AS status, CASE WHEN purpose = 'inference' THEN r.c END AS t12m_net_revenue_cents, cost_cents, ct / 8760 AS average_contracted_mw, en / 8760 AS average_energized_mw, cs / 8760 AS utilized_mw, cs / en AS energized_utilization,
        CASE WHEN purpose = 'inference' THEN r.c * 8760 / 100.0::DOUBLE / ct END AS revenue_per_contracted_mw, CASE WHEN purpose = 'inference' THEN r.c * 8760 / 100.0::DOUBLE / cs END AS revenue_per_utilized_mw
        FROM (SELECT purpose, sum(cost_cents)::BIGINT AS cost_cents, sum(contracted)::DOUBLE AS ct, sum(energized)::DOUBLE AS en, sum(consumed)::DOUBLE AS cs FROM comp WHERE month >= DATE '2000-08-01' GROUP BY purpose), (SELECT sum(revenue_cents)::BIGINT AS c FROM rec WHERE month >= DATE '2000-08-01') r"""),
    "nrr_members": sql("SELECT * FROM mem3"),
    "consumption_nrr": sql("""SELECT DATE '2001-07-31' AS month, lens, 'defined' AS status, n AS cohort_customers, ab AS all_base_cents, b AS base_revenue_cents, c AS current_revenue_cents, e AS expansion_cents, d AS contraction_cents, g AS churn_cents,
        c::DOUBLE / b AS nrr, e::DOUBLE / b AS expansion_share, d::DOUBLE / b AS contraction_share, g::DOUBLE / b AS churn_share, b::DOUBLE / ab AS cohort_revenue_coverage FROM (
        SELECT lens, count(*) FILTER (WHERE in_cohort) AS n, sum(base_cents)::BIGINT AS ab, (sum(base_cents) FILTER (WHERE in_cohort))::BIGINT AS b, (sum(current_cents) FILTER (WHERE in_cohort))::BIGINT AS c,
        (sum(greatest(current_cents - base_cents, 0)) FILTER (WHERE in_cohort))::BIGINT AS e, coalesce(sum(base_cents - current_cents) FILTER (WHERE in_cohort AND current_cents <> 0 AND base_cents > current_cents), 0)::BIGINT AS d,
        coalesce(sum(base_cents) FILTER (WHERE in_cohort AND current_cents = 0), 0)::BIGINT AS g FROM mem3 GROUP BY lens)"""),
    "model_vintage": sql("""SELECT month, model, generation, (date_diff('month', release_date, month))::BIGINT AS months_since_release, channel, revenue_cents, revenue_cents::DOUBLE / nullif(sum(revenue_cents) OVER w, 0) AS revenue_share,
        (sum(CASE WHEN release_date >= month - to_months(11) THEN revenue_cents ELSE 0 END) OVER w)::DOUBLE / nullif(sum(revenue_cents) OVER w, 0) AS released_last_12_months_share FROM (
        SELECT month, model, generation, release_date, channel, sum(c)::BIGINT AS revenue_cents FROM (SELECT month, model, generation, release_date, channel, net_revenue_cents AS c FROM tl
        UNION ALL SELECT month, rl.model, generation, release_date, channel, revenue_cents FROM rl LEFT JOIN mdl ON mdl.model = rl.model WHERE family <> 'consumption') GROUP BY ALL) WINDOW w AS (PARTITION BY month, channel)"""),
    "subscriptions": sql("""SELECT *, CASE WHEN gross_churn_monthly BETWEEN 0 AND 1 THEN 1 - pow(1 - gross_churn_monthly, 12) END AS gross_churn_annualized, (cancelled_seats + seat_removals) / nullif(daily_weighted_paid_seats, 0) AS gross_churn_daily_exposure_lens,
        revenue_cents / 100.0::DOUBLE / nullif(daily_weighted_paid_seats, 0) AS arpu, revenue_cents / 100.0::DOUBLE / nullif(daily_weighted_paid_accounts, 0) AS arpa, upgraded_accounts::DOUBLE / nullif(beginning_paid_accounts, 0) AS upgrade_rate,
        downgraded_accounts::DOUBLE / nullif(beginning_paid_accounts, 0) AS downgrade_rate, expanded_accounts::DOUBLE / nullif(beginning_paid_accounts, 0) AS seat_expansion_account_rate,
        trial_cohort_converted::DOUBLE / nullif(trial_cohort_resolved, 0) AS trial_conversion_resolved_cohort_rate, trials_started - trial_cohort_resolved AS trial_cohort_pending FROM (
        SELECT month, plan, coalesce(s.beginning_seats, 0) AS beginning_seats, coalesce(s.paid_seats, 0) AS paid_seats, coalesce(s.gross_adds, 0) AS gross_adds, coalesce(s.cancelled_seats, 0) AS cancelled_seats, coalesce(s.seat_removals, 0) AS seat_removals,
        coalesce(s.net_t, 0) AS plan_transfers_net, coalesce(s.paid_seats - s.beginning_seats, 0) AS net_adds, coalesce(s.dws, 0) AS daily_weighted_paid_seats, coalesce(s.dwa, 0) AS daily_weighted_paid_accounts, coalesce(s.bpa, 0) AS beginning_paid_accounts,
        coalesce(s.pa, 0) AS paid_accounts, coalesce(s.ua, 0) AS upgraded_accounts, 0::BIGINT AS downgraded_accounts, coalesce(s.xa, 0) AS expanded_accounts, coalesce(s.revenue_cents, 0) AS revenue_cents, coalesce(tr.trials_started, 0) AS trials_started,
        coalesce(tr.trial_cohort_converted, 0) AS trial_cohort_converted, coalesce(tr.trial_cohort_resolved, 0) AS trial_cohort_resolved, (s.cancelled_seats + s.seat_removals)::DOUBLE / nullif(s.beginning_seats, 0) AS gross_churn_monthly FROM (
        SELECT month, plan, sum(beginning_seats)::BIGINT AS beginning_seats, sum(ending_seats)::BIGINT AS paid_seats, sum(gross_adds)::BIGINT AS gross_adds, sum(cancelled_seats)::BIGINT AS cancelled_seats, sum(seat_removals)::BIGINT AS seat_removals,
        sum(transfer_in - transfer_out)::BIGINT AS net_t, sum(seat_days)::DOUBLE / max(days) AS dws, sum(account_days)::DOUBLE / max(days) AS dwa, count(DISTINCT customer) FILTER (WHERE beginning_seats > 0) AS bpa, count(DISTINCT customer) FILTER (WHERE ending_seats > 0) AS pa,
        count(DISTINCT customer) FILTER (WHERE upgraded_account > 0) AS ua, count(DISTINCT customer) FILTER (WHERE ending_seats > beginning_seats AND beginning_seats > 0) AS xa, sum(revenue_cents)::BIGINT AS revenue_cents FROM sl GROUP BY ALL) s FULL JOIN tr USING (month, plan))"""),
    "customer_cohorts": sql("""SELECT q.e AS month, threshold_cents, count(*) FILTER (WHERE revenue_cents > threshold_cents) AS customers, coalesce(sum(revenue_cents) FILTER (WHERE revenue_cents > threshold_cents), 0)::BIGINT AS cohort_revenue_cents, coalesce(sum(revenue_cents), 0)::BIGINT AS total_revenue_cents,
        coalesce(sum(revenue_cents) FILTER (WHERE revenue_cents > threshold_cents), 0)::DOUBLE / nullif(sum(revenue_cents), 0) AS net_revenue_share FROM (SELECT (month_end - 1)::DATE AS e FROM cal WHERE month(month) % 3 = 0 AND month_end >= DATE '1996-01-01') q CROSS JOIN th LEFT JOIN qr ON qr.quarter_end = q.e GROUP BY ALL"""),
    "cohort_members": sql("SELECT quarter_end AS month, ultimate_parent, revenue_cents, threshold_cents FROM qr, th WHERE revenue_cents > threshold_cents"),
    "customer_history": sql("""SELECT customer, CASE WHEN k % 5 = 4 THEN 'c' || (k // 5) END AS parent, DATE '1995-01-01' AS valid_from, CASE WHEN k % 50 = 7 AND k >= 57 THEN DATE '1999-06-15' END AS valid_to FROM cus
        UNION ALL SELECT customer, 'c' || (k - 50), DATE '1999-06-15', NULL FROM cus WHERE k % 50 = 7 AND k >= 57"""),
    "dim_contract": sql("SELECT activity_id, customer, contract_id, channel, first AS valid_from, stop AS valid_to, CASE WHEN y < 2001 THEN stop END AS next_start FROM con"),
    "late_arrivals": sql("""SELECT 'inv:' || o AS activity_id, 'usage_invoiced' AS activity, TRUE AS visible FROM ord WHERE o % 18 = 0 AND month = DATE '2001-06-01' AND o IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT 'cred:' || o, 'credit_issued', FALSE FROM ord WHERE o % 67 = 0 AND month = DATE '2001-06-01' AND o IN (SELECT l_orderkey FROM lineitem)"""),
    "customer_month": sql("""SELECT who.customer, who.ultimate_parent, who.segment, who.channel, calendar.month, calendar.days, coalesce(r.n, 0)::BIGINT AS net_revenue_cents, coalesce(r.c, 0)::BIGINT AS consumption_cents, coalesce(r.s, 0)::BIGINT AS subscription_cents,
        coalesce(r.d, 0)::BIGINT AS credit_cents, coalesce(r.x, 0)::BIGINT AS commit_expiry_cents, coalesce(u.tokens, 0)::BIGINT AS tokens, coalesce(z.b, 0)::BIGINT AS beginning_seats, coalesce(z.e, 0)::BIGINT AS ending_seats, coalesce(z.sd, 0)::BIGINT AS seat_days, coalesce(z.ad, 0)::BIGINT AS account_days
        FROM who CROSS JOIN calendar LEFT JOIN (SELECT customer, month, sum(revenue_cents) AS n, sum(revenue_cents) FILTER (WHERE family = 'consumption') AS c, sum(revenue_cents) FILTER (WHERE family = 'subscription') AS s, sum(revenue_cents) FILTER (WHERE family = 'credit') AS d, sum(revenue_cents) FILTER (WHERE family = 'commit_expiry') AS x FROM fam GROUP BY ALL) r ON r.customer = who.customer AND r.month = calendar.month
        LEFT JOIN (SELECT customer, month, sum(tokens) AS tokens FROM tok GROUP BY ALL) u ON u.customer = who.customer AND u.month = calendar.month
        LEFT JOIN (SELECT customer, month, sum(beginning_seats) AS b, sum(ending_seats) AS e, sum(seat_days) AS sd, sum(account_days) AS ad FROM sl GROUP BY ALL) z ON z.customer = who.customer AND z.month = calendar.month"""),
    "consumption_nrr_v2": nrr("mem2"),
    "consumption_nrr_v1": nrr("mem2", shares_always=True),
    "consumption_nrr_v1_early": early(nrr("mem2", shares_always=True)),
    "consumption_nrr_early": early(nrr("mem3")),
    "newly_visible": sql("""SELECT 'inv:' || o AS activity_id, 'usage_invoiced' AS activity, customer FROM ord WHERE o % 18 = 0 AND month = DATE '2001-07-01' AND o IN (SELECT l_orderkey FROM lineitem)"""),
    "account_bridge": sql("""SELECT DATE '2001-07-01' AS month, account, delta_cents::BIGINT AS delta_cents FROM (SELECT unnest(['2100', '1100', '4000', '4095']) AS account, unnest([d, n - d - f, -n, f]) AS delta_cents FROM (
        SELECT (SELECT coalesce(sum(net), 0) FROM late) AS n, (SELECT coalesce(sum(fee), 0) FROM late) AS f, (SELECT coalesce(sum(least(20000000, was + more) - least(20000000, was)), 0) FROM (
        SELECT late.contract_id, sum(late.net) AS more, coalesce(any_value(e.was), 0) AS was FROM late LEFT JOIN (SELECT contract_id, sum(net) AS was FROM inv WHERE contract_id IS NOT NULL GROUP BY 1) e ON e.contract_id = late.contract_id WHERE late.contract_id IS NOT NULL GROUP BY 1)) AS d)) WHERE delta_cents <> 0"""),
    "invoice_amounts": sql("""SELECT activity_id, m AS month, days, lo, hi, ((2 * net * hi + days) // (2 * days) - (2 * net * lo + days) // (2 * days))::BIGINT AS net, ((2 * fee * hi + days) // (2 * days) - (2 * fee * lo + days) // (2 * days))::BIGINT AS fee,
        ((2 * draw * hi + days) // (2 * days) - (2 * draw * lo + days) // (2 * days))::BIGINT AS draw FROM (SELECT activity_id, net::HUGEINT AS net, fee::HUGEINT AS fee, draw::HUGEINT AS draw, (month + to_months(i::INT))::DATE AS m, date_diff('day', month, (month + to_months(3))::DATE)::BIGINT AS days,
        date_diff('day', month, (month + to_months(i::INT))::DATE)::BIGINT AS lo, date_diff('day', month, (month + to_months(i::INT + 1))::DATE)::BIGINT AS hi FROM fund, range(3) t(i)) WHERE m < DATE '2001-08-01'"""),
    "yield_bridge": sql("""SELECT *, old_tokens AS new_tokens, 0::BIGINT AS delta_tokens, (old_net_revenue_cents + delta_net_revenue_cents)::BIGINT AS new_net_revenue_cents, (old_channel_fee_cents + delta_channel_fee_cents)::BIGINT AS new_channel_fee_cents,
        (old_before_fees_cents + delta_before_fees_cents)::BIGINT AS new_before_fees_cents, round(delta_net_revenue_cents * 10000.0::DOUBLE / old_tokens, 12) AS delta_after_fees_per_mtok, round(delta_before_fees_cents * 10000.0::DOUBLE / old_tokens, 12) AS delta_before_fees_per_mtok FROM
        (SELECT sum(tokens)::BIGINT AS old_tokens, sum(net_revenue_cents)::BIGINT AS old_net_revenue_cents, sum(channel_fee_cents)::BIGINT AS old_channel_fee_cents, sum(net_revenue_cents + channel_fee_cents)::BIGINT AS old_before_fees_cents FROM tl WHERE month = DATE '2001-07-01'),
        (SELECT coalesce(sum(net - fee), 0)::BIGINT AS delta_net_revenue_cents, coalesce(sum(fee), 0)::BIGINT AS delta_channel_fee_cents, coalesce(sum(net), 0)::BIGINT AS delta_before_fees_cents FROM late)"""),
    "source_reconciliation": sql("""SELECT month, 'usage_invoiced' AS activity, status, count(*) AS n, sum(ours)::BIGINT AS our_cents, sum(theirs)::BIGINT AS their_cents FROM (
        SELECT month, CASE WHEN here AND NOT there THEN 'unexpected' WHEN NOT here THEN 'missing' WHEN o % 97 = 0 THEN 'altered' WHEN o % 89 = 0 THEN 'altered_arrival' ELSE 'matched' END AS status,
        CASE WHEN here THEN net END AS ours, CASE WHEN there THEN net + (o % 97 = 0)::INT END AS theirs FROM (SELECT o, month, net, NOT (o % 18 = 0 AND month = DATE '2001-07-01') AS here, o % 101 <> 0 AS there FROM ord WHERE o IN (SELECT l_orderkey FROM lineitem)) WHERE here OR there) GROUP BY ALL"""),
    "dim_model": sql("SELECT * FROM mdl"),
    "nrr_sensitivity": sql("""SELECT DATE '2001-07-31' AS month, lens, nrr, max(nrr) FILTER (WHERE lens = 'base_t12m') OVER () AS headline_nrr, (nrr - max(nrr) FILTER (WHERE lens = 'base_t12m') OVER ()) * 100 AS difference_pp FROM (
        SELECT lens, (sum(current_cents) FILTER (WHERE in_cohort))::DOUBLE / sum(base_cents) FILTER (WHERE in_cohort) AS nrr FROM mem3 GROUP BY lens)"""),
    "yield_summary": sql("""SELECT sum(tokens)::BIGINT AS tokens, sum(net_revenue_cents)::BIGINT AS net_revenue_cents, sum(channel_fee_cents)::BIGINT AS channel_fee_cents, round(sum(net_revenue_cents) * 10000.0::DOUBLE / sum(tokens), 12) AS after_fees_per_mtok,
        round(sum(net_revenue_cents + channel_fee_cents) * 10000.0::DOUBLE / sum(tokens), 12) AS before_fees_per_mtok FROM tl WHERE month = DATE '2001-06-01'"""),
    "stg_contracts": sql("SELECT activity_id, customer, contract_id, channel, 12::INT AS term_months, 20000000::BIGINT AS commit_cents, first AS start, stop AS \"end\" FROM con"),
    "stg_invoices": sql("SELECT activity_id, customer, invoice_id, batch AS usage_batch_id, contract_id, month AS period_start, month_end AS period_end, net AS gross_cents, 0::BIGINT AS discount_cents, net AS net_cents, fee::BIGINT AS fee_cents, channel FROM inv"),
    "stg_credits": sql("SELECT activity_id, customer, credit_id, invoice_id, month AS period, amount FROM cred"),
    "stg_expiries": sql("SELECT activity_id, customer, contract_id FROM ended"),
    "stg_usage": sql("SELECT activity_id, customer, month, batch AS usage_batch_id, model, token_type, channel, workload, tokens, rated AS rated_cents FROM tok"),
    "stg_subscription_events": sql("SELECT activity_id, customer, sid AS subscription_id, kind AS activity, plan, seats::BIGINT AS paid_seats, rank::INT AS priority FROM state"),
    "stg_customers": sql("SELECT customer, segment, channel, country, CASE WHEN k % 5 = 4 THEN 'c' || (k // 5) END AS parent_customer FROM cus"),
    "customer_timeline": sql("""SELECT who.*, DATE '1995-01-01' AS first_activity, last.d AS last_activity, NULL::DATE AS last_churn, z.contract_id, z.contract_state, z.contract_state_at, y.subscription_state, y.subscription_state_at FROM who
        JOIN (SELECT customer, max(d)::DATE AS d FROM (SELECT customer, DATE '1995-01-01' AS d FROM cus UNION ALL SELECT customer, DATE '1999-06-15' FROM cus WHERE k % 50 = 7 AND k >= 57 UNION ALL SELECT customer, (month + to_months(1))::DATE - 1 FROM tok
            UNION ALL SELECT customer, first FROM con UNION ALL SELECT customer, s FROM sub UNION ALL SELECT customer, day FROM ev) GROUP BY customer) last USING (customer)
        LEFT JOIN (SELECT customer, 'k' || k || ':2000' AS contract_id, 'contract_expired' AS contract_state, DATE '2001-01-01' AS contract_state_at FROM cus WHERE channel = 'direct' AND k % 3 = 0) z USING (customer)
        LEFT JOIN (SELECT customer, CASE WHEN k % 7 = 0 THEN 'subscription_cancelled' ELSE 'subscription_started' END AS subscription_state, CASE WHEN k % 7 = 0 THEN (s + to_months(30))::DATE ELSE s + 14 END AS subscription_state_at FROM sub) y USING (customer)"""),
}
