"""The star-schema tables read as an activity stream, by integer arithmetic only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.lineage import parts

CHANNELS = ["direct", "aws_marketplace", "gcp_marketplace", "azure_marketplace"]
KINDS = ["input", "output", "cache_read", "cache_write"]
WORKLOADS = ["api", "batch", "agent"]
PLANS, PRICES = ["pro", "max", "team", "enterprise"], [20, 60, 35, 80]
FIRST, STOP = "1995-01-01", "2001-08-01"


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _usd(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("string")


def _rows(df: DataFrame, kind: Column | str, key: Column, ts: Column, who: Column, features: dict[str, Column], late: Column | None = None) -> DataFrame:
    activity = F.lit(kind) if isinstance(kind, str) else kind
    stamp = ts.cast("timestamp")
    return df.select(
        key.alias("activity_id"),
        stamp.alias("ts"),
        who.cast("string").alias("customer"),
        F.lit(None).cast("string").alias("anonymous_customer_id"),
        activity.alias("activity"),
        F.to_json(F.struct(*[c.alias(n) for n, c in sorted(features.items())]), {"ignoreNullFields": "false"}).alias("feature_json"),
        F.lit(None).cast("decimal(18,2)").alias("revenue_impact"),
        F.lit(None).cast("string").alias("link"),
        (stamp if late is None else stamp + F.make_dt_interval(late)).alias("_recorded_at"),
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    named = table("customer").join(F.broadcast(table("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.withColumn("channel", _pick(CHANNELS, F.col("c_nationkey") % 4))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' channel: they are fewer and narrower than lines, which then move once, by order."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", month.alias("month"))
    count, customers = parts(orders), _customers(spark, sf_dir).select("c_custkey", "channel")
    return orders.repartition(count, "o_custkey").join(customers.repartition(count, "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def _month_end() -> Column:
    return F.add_months(F.col("month"), 1).cast("timestamp") - F.expr("interval 1 microsecond")


def _from_adapter(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_source": F.lit("sim:td"), "_actor": F.lit("adapter"), "_lane": F.lit("sim"), "_schema_hash": F.lit("td-1")})


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's usage, a row for each line of an order."""
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*lines.columns))
    count = parts(lines)  # by rows, so that a task's memory doesn't grow with the tables
    tokens = lines.repartition(count, "l_orderkey").withColumn("n", n).join(_orders(spark, sf_dir).repartition(count, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = (F.round(F.col("l_extendedprice") * 100).cast("long") % 5000) / 100.0
    return _from_adapter(_rows(tokens, "tokens_processed", text("tok:", F.col("l_orderkey"), ":", F.col("n")), _month_end(), text("c", F.col("o_custkey")), {
        "usage_batch_id": text("b", F.col("l_orderkey")), "model": text("g", F.least(F.lit(5), F.year("month") - 1994)), "model_release_date": F.add_months(F.lit(FIRST).cast("date"), (F.least(F.lit(5), F.year("month") - 1994) - 1) * 12), "token_type": _pick(KINDS, F.col("l_linenumber") % 4),
        "tokens": (F.col("l_quantity") * 100000).cast("long"), "list_price_per_mtok": price, "effective_price_per_mtok": price, "channel": F.col("channel"), "workload": _pick(WORKLOADS, F.col("l_suppkey") % 3),
    }))


def activity_stream(spark: SparkSession, sf_dir: str, service_months: int = 1, lines: bool = True) -> DataFrame:
    """All business activities of one scale, without positions (see ``with_positions``); with ``lines`` off, all but ``token_events``."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    day = lambda text: F.lit(text).cast("date")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    k = F.col("c_custkey")
    customers = _customers(spark, sf_dir)
    out = [
        _rows(customers, "customer_created", text("cust:", k), day(FIRST), text("c", k), {"segment": F.col("c_mktsegment"), "channel": F.col("channel"), "country": F.col("n_name"), "parent_customer": F.when(k % 5 == 4, text("c", F.expr("c_custkey div 5")))}),
        _rows(customers.filter((k % 50 == 7) & (k >= 57)), "customer_merged", text("merge:", k), day("1999-06-15"), text("c", k), {"ultimate_parent": text("c", k - 50), "reason": F.lit("acquired")}),
    ]
    released = F.add_months(day(FIRST), F.col("r_regionkey") * 12)
    out.append(_rows(table("region"), "model_released", text("model:", F.col("r_regionkey")), released, F.lit(None), {"model": text("g", F.col("r_regionkey") + 1), "generation": F.col("r_regionkey") + 1, "release_date": released, "training_cost_usd_estimate": F.lit("1000000.00")}))

    last, orders = _month_end(), _orders(spark, sf_dir)
    line_keys = table("lineitem").select("l_orderkey")
    count = parts(line_keys)
    billed = orders.repartition(count, "o_orderkey").join(line_keys.repartition(count, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    billed = billed.withColumn("net", F.round(F.col("o_totalprice") * 100).cast("long")).withColumn("fee", F.when(F.col("channel") != "direct", F.expr("net * 5 div 100")).otherwise(0))
    o = F.col("o_orderkey")
    contract = F.when((F.col("channel") == "direct") & (F.col("o_custkey") % 3 == 0), text("k", F.col("o_custkey"), ":", F.year("month")))
    out.append(_rows(billed, "usage_invoiced", text("inv:", o), last, text("c", F.col("o_custkey")), {
        "invoice_id": text("i", o), "usage_batch_id": text("b", o), "contract_id": contract, "period_start": F.col("month"), "period_end": F.add_months("month", service_months),
        "gross_usd": _usd(F.col("net")), "discount_usd": F.lit("0.00"), "net_usd": _usd(F.col("net")), "channel_fee_usd": _usd(F.col("fee")), "channel": F.col("channel"),
        "commit_applied_usd": F.lit("0.00"), "cash_due_usd": _usd(F.col("net")),
    }, F.when(o % 18 == 0, 10).otherwise(0)))
    out.append(_rows(billed.filter(o % 67 == 0), "credit_issued", text("cred:", o), last, text("c", F.col("o_custkey")), {"credit_id": text("cr", o), "invoice_id": text("i", o), "period": F.col("month"), "amount_usd": _usd(F.expr("net * 5 div 100")), "reason": F.lit("service")}, F.lit(20)))

    years = customers.filter((F.col("channel") == "direct") & (k % 3 == 0)).withColumn("y", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    start, end = F.make_date("y", F.lit(1), F.lit(1)), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1))
    longer = F.make_date(F.col("y") + (2 if service_months > 1 else 1), F.lit(1), F.lit(1))
    out.append(_rows(years, "contract_signed", text("con:", k, ":", F.col("y")), start, text("c", k), {"contract_id": text("k", k, ":", F.col("y")), "term_months": F.lit(12), "commit_usd": F.lit("200000.00"), "discount_pct": F.lit(0), "channel": F.col("channel"), "start": start, "end": longer}))
    if service_months == 1:
        out.append(_rows(years.filter("y <= 2000"), "contract_expired", text("exp:", k, ":", F.col("y")), end, text("c", k), {"contract_id": text("k", k, ":", F.col("y")), "reason": F.lit("term")}))

    subs = customers.filter(k % 4 == 1).withColumns({"s": F.add_months(day(FIRST), (k % 24).cast("int")), "p": F.expr("cast(c_custkey div 4 % 4 as int)"), "seats": (1 + k % 9).cast("long")})
    plan, better = _pick(PLANS, F.col("p")), _pick(PLANS, (F.col("p") + 1) % 4)
    price, dearer = _pick(PRICES, F.col("p")), _pick(PRICES, (F.col("p") + 1) % 4)
    began, trial, sub = F.date_add("s", 14), text("t", k), text("s", k)
    who, more = text("c", k), F.col("seats") + 2
    out += [
        _rows(subs, "trial_started", text("trial:", k), F.col("s"), who, {"trial_id": trial, "plan": plan, "seats": F.col("seats"), "end": began}),
        _rows(subs.filter(k % 3 == 0), "trial_expired", text("outcome:", k), began, who, {"trial_id": trial, "reason": F.lit("term")}),
        _rows(subs.filter(k % 3 != 0), "trial_converted", text("outcome:", k), began, who, {"trial_id": trial, "subscription_id": sub, "plan": plan, "seats": F.col("seats")}),
        _rows(subs, "subscription_started", text("sub:", k), began, who, {"subscription_id": sub, "plan": plan, "seats": F.col("seats"), "price_per_seat": _usd(price * 100), "billing_period": F.lit("monthly"), "period_start": began, "period_end": F.lit(STOP)}),
        _rows(subs, "seat_added", text("seat:", k), F.add_months("s", 5), who, {"subscription_id": sub, "plan": plan, "seats": F.lit(2), "seats_after": more}),
        _rows(subs, "subscription_upgraded", text("up:", k), F.add_months("s", 8), who, {"subscription_id": sub, "plan": better, "seats": more, "price_per_seat": _usd(dearer * 100), "billing_period": F.lit("monthly"), "period_start": F.add_months("s", 8), "period_end": F.lit(STOP)}),
        _rows(subs.filter(k % 7 == 0), "subscription_cancelled", text("cancel:", k), F.add_months("s", 30), who, {"subscription_id": sub, "plan": better, "seats": more, "reason": F.lit("price")}),
    ]
    r = F.col("r_regionkey")
    sites = table("region").withColumn("purpose", F.explode(F.array(F.lit("inference"), F.lit("training"))))
    sites = sites.withColumn("mw", (r + 1) * F.when(F.col("purpose") == "inference", 10).otherwise(5)).withColumn("rate", F.lit(50) + 5 * r)
    cap = {"capacity_id": text("cap:", r, ":", F.col("purpose")), "provider": text("p", r), "region": text("r", r)}
    key = lambda kind, *more: text(f"{kind}:", r, ":", F.col("purpose"), *more)
    out.append(_rows(sites, "capacity_contracted", key("cap"), day(FIRST), F.lit(None), cap | {"mw": F.col("mw"), "usd_per_mwh": _usd(F.col("rate") * 100), "start": F.lit(FIRST), "end": F.lit(STOP), "purpose": F.col("purpose")}))
    steps = sites.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2))))
    share = _pick([35, 70, 100], F.col("step"))
    out.append(_rows(steps, "capacity_energized", key("on", ":", F.col("step")), F.add_months(day(FIRST), F.col("step") * 6), F.lit(None), cap | {"mw": (F.col("mw") * share / 100).cast("decimal(12,2)")}))
    meters = sites.withColumn("month", F.explode(F.sequence(day(FIRST), F.add_months(day(STOP), -1), F.expr("interval 1 month"))))
    hours = F.datediff(F.add_months("month", 1), "month") * 12
    out.append(_rows(meters, "capacity_consumed", key("use", ":", F.col("month")), last, F.lit(None), cap | {"mwh": F.col("mw") * hours, "purpose": F.col("purpose"), "model": text("g", F.least(F.lit(5), F.year("month") - 1994)), "period_start": F.col("month"), "period_end": F.add_months("month", 1), "allocation_basis": F.lit("metered")}))
    stream = out[0]
    for rows in out[1:]:
        stream = stream.unionByName(rows)
    stream = _from_adapter(stream)
    return stream.unionByName(token_events(spark, sf_dir)) if lines else stream


def _plain(kind: str, key: Column, day: str, who: Column, features: dict[str, Column], frame: DataFrame, source: str = "sim:bad") -> DataFrame:
    rows = _rows(frame, kind, key, F.lit(day).cast("date"), who, features)
    return rows.withColumns({"_source": F.lit(source), "_actor": F.lit("adapter"), "_lane": F.lit("sim"), "_schema_hash": F.lit("td-1")})


def planted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities that break the data controls, one set for each customer whose key leaves 3 when divided by 100.

    All but the meter of an unknown model come from a source of their own and carry no money unless the fault is about
    money, so each set adds the same known number of failures to each control.
    """
    bad = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 100 = 3").select(F.col("c_custkey").alias("k"))
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    k, day, nil = F.col("k"), "2000-03-10", F.lit(None).cast("string")
    who, other = text("x", k), text("x", k, "v")
    out: list[DataFrame] = []

    def add(kind: str, key: str, customer: Column, features: dict[str, Column], copies: int = 1, when: str = day, source: str = "sim:bad") -> None:
        for n in range(copies):
            out.append(_plain(kind, text(f"bad:{kind}:{key}:{n}:", k), when, customer, features, bad, source))

    def person(suffix: str, parent: Column = nil, copies: int = 1) -> None:
        about = {"segment": F.lit("none"), "channel": F.lit("direct"), "country": F.lit("none"), "parent_customer": parent}
        add("customer_created", suffix or "main", text("x", k, suffix), about, copies, "2000-01-01")

    def bill(document: str, batch: Column, gross: str = "0.00", net: str = "0.00", copies: int = 1) -> None:
        add("usage_invoiced", document, who, {
            "invoice_id": text(document, k), "usage_batch_id": batch, "contract_id": nil, "period_start": F.lit("2000-03-01"), "period_end": F.lit("2000-04-01"),
            "gross_usd": F.lit(gross), "discount_usd": F.lit("0.00"), "net_usd": F.lit(net), "channel_fee_usd": F.lit("0.00"), "channel": F.lit("direct"),
        }, copies)

    def deal(contract: str, customer: Column, copies: int = 1) -> None:
        terms = {"term_months": F.lit(12), "commit_usd": F.lit("0.00"), "channel": F.lit("direct"), "start": F.lit("2000-01-01"), "end": F.lit("2001-01-01")}
        add("contract_signed", contract, customer, {"contract_id": text(contract, k)} | terms, copies)

    def subscribe(name: str, customer: Column, seats: int, price: str = "0.00", billing: str = "monthly", until: str = STOP, when: str = day) -> None:
        about = {"subscription_id": text(name, k), "plan": F.lit("pro"), "seats": F.lit(seats), "price_per_seat": F.lit(price), "billing_period": F.lit(billing), "period_end": F.lit(until)}
        add("subscription_started", name, customer, about, when=when)

    def use(batch: str, customer: Column, model: str, note: str = "") -> None:
        about = {"usage_batch_id": text(batch, k), "model": F.lit(model), "token_type": F.lit("input"), "tokens": F.lit(1), "list_price_per_mtok": F.lit(0.0), "effective_price_per_mtok": F.lit(0.0)}
        add("tokens_processed", batch + note, customer, about | {"channel": F.lit("direct"), "workload": F.lit("api")})

    for suffix in ("", "v", "w"):
        person(suffix)
    person("d", copies=2)
    person("p", text("x", k, "q"))
    person("q", text("x", k, "p"))
    person("o", text("nowhere", k))
    deal("xghost", text("ghost", k))
    deal("xtwice", who, 2)
    deal("xended", who)
    add("contract_expired", "twice", who, {"contract_id": text("xended", k), "reason": F.lit("term")}, 2)
    add("contract_expired", "none", who, {"contract_id": text("xnone", k), "reason": F.lit("term")})
    bill("xgross", text("xgb", k), gross="1.00")
    bill("xagain", text("xab", k), copies=1)
    out.append(_plain("usage_invoiced", text("bad:second:", k), day, who, {
        "invoice_id": text("xagain", k), "usage_batch_id": text("xac", k), "contract_id": nil, "period_start": F.lit("2000-03-01"), "period_end": F.lit("2000-04-01"),
        "gross_usd": F.lit("0.00"), "discount_usd": F.lit("0.00"), "net_usd": F.lit("0.00"), "channel_fee_usd": F.lit("0.00"), "channel": F.lit("direct"),
    }, bad))
    bill("xone", text("xshared", k))
    bill("xtwo", text("xshared", k))
    bill("xmoney", text("xunused", k), gross="5.00", net="5.00")
    about = {"period": F.lit("2000-03-01"), "amount_usd": F.lit("0.00"), "reason": F.lit("service")}
    add("credit_issued", "orphan", who, {"credit_id": text("xor", k), "invoice_id": text("xmissing", k)} | about)
    add("credit_issued", "twice", who, {"credit_id": text("xcr", k), "invoice_id": text("xgross", k)} | about, 2)
    subscribe("xyear", who, 0, billing="annual")
    add("seat_added", "first", who, {"subscription_id": text("xearly", k), "plan": F.lit("pro"), "seats": F.lit(0), "seats_after": F.lit(0)})
    subscribe("xleft", other, 1)
    subscribe("xright", other, 1)
    subscribe("xshort", text("x", k, "w"), 1, until="2000-06-15")
    subscribe("xlost", text("lost", k), 1, price="1.00", when="2001-06-01")
    add("trial_started", "twice", who, {"trial_id": text("xtrial", k), "plan": F.lit("pro"), "seats": F.lit(1)}, 2)
    add("model_released", "twice", nil, {"model": text("xm", k), "generation": F.lit(9), "release_date": F.lit("2000-01-01")}, 2)
    place = {"provider": F.lit("p0"), "region": F.lit("r0")}
    meter = place | {"mwh": F.lit(1), "purpose": F.lit("inference"), "period_start": F.lit("2000-03-01"), "period_end": F.lit("2000-04-01")}
    add("capacity_consumed", "unknown", nil, meter | {"capacity_id": text("xcap", k), "model": F.lit("g1")})
    add("capacity_consumed", "idle", nil, meter | {"capacity_id": F.lit("cap:0:inference"), "model": text("zz", k)}, source="sim:td")
    site = place | {"mw": F.lit(0), "usd_per_mwh": F.lit("0.00"), "start": F.lit("2000-01-01"), "end": F.lit("2000-02-01"), "purpose": F.lit("training")}
    add("capacity_contracted", "twice", nil, {"capacity_id": text("xdoc", k)} | site, 2)
    use("xorphan", who, "none")
    use("xmixed", who, "g1")
    use("xmixed", other, "g1", ":other")
    use("xdouble", text("x", k, "d"), "g1")
    stream = out[0]
    for rows in out[1:]:
        stream = stream.unionByName(rows)
    return stream


def asserted_stream(spark: SparkSession, sf_dir: str, faults: bool = False, lines: bool = True) -> DataFrame:
    """The activity stream with recognition events of its own: invoices, credits and expired commitments, each in its month.

    With ``faults``, orders whose key leaves a certain rest when divided by 500 get a fault of one kind each.
    """
    act = activity_stream(spark, sf_dir, lines=lines)
    field = lambda name: F.get_json_object("feature_json", f"$.{name}")
    usd = lambda name: field(name).cast("decimal(18,2)")
    number = F.coalesce(F.regexp_extract("activity_id", r"^(?:inv|cred):(\d+)$", 1).try_cast("long"), F.lit(0))
    rest = number % 500 if faults else F.lit(0)
    base = act.withColumn("rest", F.when(number > 0, rest).otherwise(0))
    billed = base.filter("activity = 'usage_invoiced'")

    def recognise(rows: DataFrame, source: str, kind: str, document: Column, amount: Column, period: Column) -> DataFrame:
        features = {"period": period, "net_usd": amount.cast("string"), "source": F.when(F.col("rest") == 9, "gift").otherwise(source), "recognition_kind": F.lit(kind), "source_document": document, "channel": F.coalesce(field("channel"), F.lit("direct"))}
        made = rows.select(
            F.concat(F.lit("rec:"), "activity_id").alias("activity_id"), "ts", "customer", "anonymous_customer_id", F.lit("revenue_recognized").alias("activity"),
            F.to_json(F.struct(*[c.alias(n) for n, c in sorted(features.items())]), {"ignoreNullFields": "false"}).alias("feature_json"),
            amount.cast("decimal(18,2)").alias("revenue_impact"), "link", "_recorded_at", "_source", "_actor", "_lane", "_schema_hash",
        )
        return made

    month = F.trunc(F.col("ts").cast("date"), "month")
    net = usd("net_usd") - usd("channel_fee_usd") + F.when(F.col("rest") == 1, F.lit("0.01").cast("decimal(18,2)")).otherwise(0)
    own = F.when(F.col("rest") == 5, F.concat(field("invoice_id"), F.lit("?"))).otherwise(field("invoice_id"))
    period = F.when(F.col("rest") == 3, F.add_months(month, 1)).otherwise(month)
    credit = -usd("amount_usd") - F.when(F.col("rest") == 67, F.lit("0.01").cast("decimal(18,2)")).otherwise(0)
    made = recognise(billed, "usage", "usage", own, net, period).unionByName(recognise(base.filter("activity = 'credit_issued'"), "usage", "credit", field("credit_id"), credit, month))
    ended = base.filter("activity = 'contract_expired'")
    paid = ended
    if faults:  # of some customers the expired commitment is not recognised
        paid = ended.filter(F.regexp_extract("activity_id", r"^exp:(\d+):", 1).cast("long") % 50 != 3)
    left = F.lit("200000.00").cast("decimal(18,2)")
    made = made.unionByName(recognise(paid, "commit_drawdown", "commit_expiry", field("contract_id"), left, month))
    ended_json = F.concat(F.expr("substring(feature_json, 1, length(feature_json) - 1)"), F.lit(',"unconsumed_commit_usd":"200000.00"}'))
    out = act.withColumn("feature_json", F.when(F.col("activity") == "contract_expired", ended_json).otherwise(F.col("feature_json"))).unionByName(made)
    if not faults:
        return out
    # A merger of a customer with itself, and an event of a customer before its creation.
    selfish = billed.filter("rest = 11").select(
        F.concat(F.lit("self:"), "activity_id").alias("activity_id"), "ts", "customer", "anonymous_customer_id", F.lit("customer_merged").alias("activity"),
        F.to_json(F.struct(F.lit("acquired").alias("reason"), F.col("customer").alias("ultimate_parent"))).alias("feature_json"), "revenue_impact", "link", "_recorded_at", "_source", "_actor", "_lane", "_schema_hash",
    )
    early = billed.filter("rest = 13").select(
        F.concat(F.lit("early:"), "activity_id").alias("activity_id"), F.lit("1994-12-31").cast("timestamp").alias("ts"), "customer", "anonymous_customer_id", F.lit("usage_viewed").alias("activity"),
        F.lit('{"period_end":"1995-01-01","period_start":"1995-01-01"}').alias("feature_json"), "revenue_impact", "link", "_recorded_at", "_source", "_actor", "_lane", "_schema_hash",
    )
    return out.unionByName(selfish).unionByName(early)


def asserted_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognition events of the customers of ``planted_faults`` that break invariants of asserted revenue: an unknown pair of source
    and kind, a period after the event's month, a document that doesn't exist, and an invoice of 5.00 recognised with 3.00."""
    bad = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 100 = 3").select(F.col("c_custkey").alias("k"))
    text = lambda name: F.concat(F.lit(name), F.col("k").cast("string"))
    out = []
    for document, source, period, usd in (("xmoney", "gift", "2000-03-01", "0.00"), ("xgross", "usage", "2000-04-01", "0.00"), ("xnothing", "usage", "2000-03-01", "0.00"), ("xmoney", "usage", "2000-03-01", "3.00")):
        about = {"period": F.lit(period), "net_usd": F.lit(usd), "source": F.lit(source), "recognition_kind": F.lit("usage"), "source_document": text(document), "channel": F.lit("direct")}
        rows = _plain("revenue_recognized", text(f"bad:rec:{document}:{source}:"), "2000-03-10", text("x"), about, bad)
        out.append(rows.withColumn("revenue_impact", F.lit(usd).cast("decimal(18,2)")))
    return reduce(DataFrame.unionByName, out)


#: Fixed value: the counter source that usage reports read.
COUNTER_SOURCE = "local-token-count/v1"
COUNTED = ["input", "output", "total"]


def counter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage activities from ``events``: counters of several sessions and sources, inventories and quarantined sources.

    An account is a user, a session one kind of event of a few users, so sessions of an account interleave in time. Each event
    is a cumulative reading of two counters, with missing readings and resets, and now and then an interval reading.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    rows = e.withColumn("scope_id", F.concat("event_type", F.lit("-"), (F.col("user_id") % 7).cast("string"))).withColumn("account", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))
    rows = rows.withColumn("so_far", F.sum("value").over(Window.partitionBy("account", "scope_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    key = F.col("event_id")
    whole = F.when(key % 53 == 0, F.lit(None).cast("long")).when(key % 41 == 0, 0).otherwise(F.col("so_far"))
    source = F.when(key % 97 == 0, "other/v1").otherwise(COUNTER_SOURCE)
    reading = lambda kind, mode, value: F.struct(F.lit(kind).alias("token_kind"), F.lit(mode).alias("temporality"), value.cast("long").alias("quantity"))
    part = F.expr("value * 3 div 4")
    last = [reading("input", "interval_total", part), reading("output", "interval_total", F.col("value") - part), reading("total", "interval_total", F.col("value") + F.when(key % 29 == 0, 1).otherwise(0))]
    readings = F.concat(F.array(reading("input", "cumulative", whole), reading("output", "cumulative", F.expr("so_far div 3"))), F.when(key % 11 == 0, F.array(*last)).otherwise(F.array()))
    rows = rows.withColumn("source", source).withColumn("r", F.explode(readings))
    observed = F.to_json(F.struct(
        F.lit("m").alias("model"), F.concat(F.lit("o:"), "scope_id", F.lit(":"), F.col("event_id").cast("string")).alias("observation_id"), F.col("r.quantity").alias("quantity"), F.lit(1).alias("revision"),
        "scope_id", "source", F.col("r.temporality").alias("temporality"), F.col("r.token_kind").alias("token_kind"),
    ), {"ignoreNullFields": "false"})
    stamp = {"_lane": F.lit("dev"), "_source": F.lit("counters")}
    out = rows.select(
        F.concat_ws(":", F.lit("use"), F.col("event_id").cast("string"), "r.temporality", "r.token_kind").alias("activity_id"), "ts", F.col("account").alias("customer"), F.lit("usage_observed").alias("activity"),
        observed.alias("feature_json"), F.lit(None).cast("string").alias("link"), (F.col("ts") + F.expr("interval 1 hour")).alias("_recorded_at"),
    ).withColumns(stamp)
    people = e.select((F.col("user_id") % 45).alias("u")).distinct()
    surface = F.explode(F.array(F.lit("cli"), F.lit("web"))).alias("surface")
    listed = people.select("u", surface).withColumn("ts", F.lit("2024-01-02").cast("timestamp"))
    out = out.unionByName(listed.select(
        F.concat(F.lit("inv:u"), F.col("u").cast("string"), F.lit(":"), "surface").alias("activity_id"), "ts", F.concat(F.lit("u"), F.col("u").cast("string")).alias("customer"), F.lit("application_inventory").alias("activity"),
        F.to_json(F.struct(F.lit("vendor").alias("provider"), F.lit("account").alias("scope"), "surface")).alias("feature_json"), F.lit(None).cast("string").alias("link"), F.col("ts").alias("_recorded_at"),
    ).withColumns(stamp))
    held = e.filter("event_id % 1000 = 7")
    return out.unionByName(held.select(
        F.concat(F.lit("cov:"), F.col("event_id").cast("string")).alias("activity_id"), "ts", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("customer"), F.lit("usage_coverage").alias("activity"),
        F.to_json(F.struct(F.lit("2024-02-01").alias("interval_end"), F.lit("2024-01-01").alias("interval_start"), F.lit("inspect").alias("next_action"), F.lit("unreadable").alias("reason"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("scope_id"), F.when(F.col("event_id") % 3000 == 7, "other/v1").otherwise(COUNTER_SOURCE).alias("source"))).alias("feature_json"),
        F.lit("evidence:failures/x").alias("link"), F.col("ts").alias("_recorded_at"),
    ).withColumns(stamp))


def usage_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter packets from ``events``, one for each account and week: an event is a reading of a session, some with faults.

    Packets overlap by two days: events of a week's first two days stand in the week before too, as exact retries, except that
    of keys that divide by 400 the retry says something else.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    e = e.withColumns({"account": F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")), "day": F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))})
    e = e.withColumn("session", F.concat_ws("-", "event_type", "account", (F.col("user_id") % 7).cast("string")))
    so_far = F.sum("value").over(Window.partitionBy("account", "session").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("so_far", so_far).withColumn("clock", F.expr("timestamp '2024-01-01' + make_dt_interval(0, 0, 0, cast(event_id as decimal(18,6)))"))
    week = F.expr("day div 7")
    e = e.withColumn("week", F.explode(F.when((F.col("day") % 7 < 2) & (week > 0), F.array(week - 1, week)).otherwise(F.array(week))))
    key, retry = F.col("event_id"), F.col("week") != week
    inside, total = F.expr("so_far * 3 div 4"), F.col("so_far") + F.when((key % 2000 == 1) | (retry & (key % 400 == 0)), 1).otherwise(0)
    whole = F.struct(
        F.when(key % 53 != 0, F.when(retry & (key % 400 == 0), inside + 1).otherwise(inside)).alias("input"), (F.col("so_far") - inside).alias("output"),
        total.alias("total"), F.when(key % 2000 == 3, F.col("so_far") + 9).otherwise(0).alias("cache_read"),
    )
    part = F.expr("value * 3 div 4")
    last = F.struct(part.alias("input"), (F.col("value") - part).alias("output"), (F.col("value") + F.when(key % 29 == 0, 1).otherwise(0)).alias("total"))
    keep = {"ignoreNullFields": "false"}
    counters = F.when(key % 3 == 0, F.to_json(F.struct(whole.alias("cumulative")), keep)).otherwise(F.to_json(F.struct(whole.alias("cumulative"), last.alias("last")), keep))
    collected = F.when(key % 2000 == 5, F.lit("2023-12-31").cast("timestamp")).otherwise(F.expr("timestamp '2024-02-10' + make_dt_interval(week)"))
    return e.select(F.concat_ws(":", "account", F.col("week").cast("string")).alias("packet"), "account", collected.alias("collected_at"), "session", key.alias("line"), F.col("clock").alias("observed_at"), counters.alias("counters"))
