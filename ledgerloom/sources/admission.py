"""Admission: payload checks against a catalogue, canonical payloads, observation status and restore checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One feature of an activity: kind is string, integer, number, money, decimal, date, timestamp or sha256."""

    kind: str = "string"
    required: bool = True
    nullable: bool = False
    enum: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


TEXT, DATE, TIME, DIGEST, MONEY, COUNT = Field(), Field("date"), Field("timestamp"), Field("sha256"), Field("money", low=0), Field("integer", low=1)
POWER, REVISION, MAYBE = Field("number", low=0), Field("integer", low=0), Field(nullable=True)
#: What the features of the activities may say.
CHANNEL = Field(enum=("direct", "aws_marketplace", "gcp_marketplace", "azure_marketplace"))
PLAN = Field(enum=("pro", "max", "team", "enterprise"))
PURPOSE = Field(enum=("inference", "training", "mixed"))
BILLING = Field(enum=("monthly", "annual"))
#: A subscription's terms, the same in four activities.
TERMS = {"subscription_id": TEXT, "plan": PLAN, "seats": COUNT, "price_per_seat": MONEY, "billing_period": BILLING, "period_start": DATE, "period_end": DATE}
CONTRACT = {"contract_id": TEXT, "term_months": COUNT, "commit_usd": MONEY, "discount_pct": Field("number", low=0, high=1), "channel": CHANNEL, "start": DATE, "end": DATE}
CAPACITY = {"capacity_id": TEXT, "provider": TEXT, "region": TEXT}
SEATS = {"subscription_id": TEXT, "plan": PLAN, "seats": COUNT, "seats_after": COUNT}
#: The features of each activity. Segments and workloads are open, as they differ between sources.
CATALOG: dict[str, dict[str, Field]] = {
    "customer_created": {"segment": TEXT, "channel": CHANNEL, "country": TEXT, "parent_customer": MAYBE},
    "customer_merged": {"ultimate_parent": TEXT, "reason": TEXT},
    "customer_churned": {"reason": TEXT},
    "contract_signed": CONTRACT,
    "contract_renewed": CONTRACT,
    "contract_expired": {"contract_id": TEXT, "reason": TEXT},
    "model_released": {"model": TEXT, "generation": COUNT, "release_date": DATE, "training_cost_usd_estimate": MONEY},
    "model_deprecated": {"model": TEXT, "replacement_model": TEXT},
    "tokens_processed": {
        "usage_batch_id": TEXT, "model": TEXT, "model_release_date": DATE, "token_type": Field(enum=("input", "output", "cache_read", "cache_write")), "tokens": COUNT,
        "list_price_per_mtok": POWER, "effective_price_per_mtok": POWER, "channel": CHANNEL, "workload": TEXT,
    },
    "usage_invoiced": {
        "invoice_id": TEXT, "usage_batch_id": TEXT, "contract_id": MAYBE, "period_start": DATE, "period_end": DATE,
        "gross_usd": MONEY, "discount_usd": MONEY, "net_usd": MONEY, "channel_fee_usd": MONEY,
        "commit_applied_usd": MONEY, "cash_due_usd": MONEY, "channel": CHANNEL,
    },
    "credit_issued": {"credit_id": TEXT, "invoice_id": TEXT, "period": DATE, "amount_usd": MONEY, "reason": TEXT},
    "revenue_recognized": {
        "period": DATE, "net_usd": Field("money"), "source": Field(enum=("usage", "subscription", "commit_drawdown")), "source_document": TEXT,
        "recognition_kind": Field(enum=("usage", "subscription", "credit", "commit_expiry")), "channel": CHANNEL,
    },
    "seat_added": SEATS,
    "seat_removed": SEATS,
    "subscription_started": TERMS,
    "subscription_renewed": TERMS,
    "subscription_upgraded": TERMS,
    "subscription_downgraded": TERMS,
    "subscription_cancelled": {"subscription_id": TEXT, "plan": PLAN, "seats": COUNT, "reason": TEXT},
    "trial_started": {"trial_id": TEXT, "plan": PLAN, "seats": COUNT, "end": DATE},
    "trial_converted": {"trial_id": TEXT, "subscription_id": TEXT, "plan": PLAN, "seats": COUNT},
    "trial_expired": {"trial_id": TEXT, "reason": TEXT},
    "capacity_contracted": CAPACITY | {"mw": POWER, "usd_per_mwh": MONEY, "start": DATE, "end": DATE, "purpose": PURPOSE},
    "capacity_energized": CAPACITY | {"mw": POWER},
    "capacity_consumed": CAPACITY | {"mwh": POWER, "purpose": PURPOSE, "model": TEXT, "allocation_basis": TEXT, "period_start": DATE, "period_end": DATE},
    "application_bound": {"application": Field(enum=("personal-usage",)), "binding_id": TEXT, "catalog_sha256": DIGEST},
    "application_inventory": {
        "provider": Field(enum=("anthropic", "openai", "grok")), "surface": TEXT, "scope": Field(enum=("laptop", "web", "mobile")), "ownership": Field(enum=("personally_owned",)),
        "plan": MAYBE, "confirmation_ref": TEXT, "collection_status": Field(enum=("uncollected", "candidate")),
    },
    "usage_charge": {
        "observation_id": TEXT, "source": TEXT, "scope_id": TEXT, "amount_decimal": Field("decimal"), "currency": TEXT,
        "basis": Field(enum=("subscription_billed", "metered_billed", "credit", "estimated", "api_equivalent")),
        "interval_start": TIME, "interval_end": TIME, "revision": REVISION, "supersedes": MAYBE, "evidence_sha256": DIGEST,
    },
    "usage_coverage": {
        "source": TEXT, "scope_id": TEXT, "interval_start": TIME, "interval_end": TIME, "coverage": Field(enum=("confirmed", "partial", "stale", "unavailable")),
        "reason": TEXT, "next_action": TEXT, "evidence_sha256": DIGEST,
    },
    "usage_observed": {
        "observation_id": TEXT, "source": TEXT, "scope_id": TEXT, "model": MAYBE, "token_kind": Field(enum=("total", "input", "output", "cache_read", "cache_write", "reasoning_output")),
        "quantity": Field("integer", nullable=True, low=0), "temporality": Field(enum=("delta", "cumulative", "interval_total")),
        "interval_start": TIME, "interval_end": TIME, "revision": REVISION, "supersedes": MAYBE, "evidence_sha256": DIGEST,
    },
}
SHAPES = {"integer": r"^-?[0-9]{1,18}$", "money": r"^-?[0-9]{1,16}(\.[0-9]{1,2})?$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$", "decimal": r"^-?[0-9]+(\.[0-9]+)?$", "sha256": r"^[0-9a-f]{64}$"}
CASTS = {"integer": "long", "number": "double", "money": "decimal(18,2)", "date": "date", "timestamp": "timestamp", "string": "string", "decimal": "string", "sha256": "string"}


def _value(name: str) -> Column:
    return F.get_json_object("feature_json", f"$.{name}")


RULES = "map<string,array<struct<name:string,kind:string,required:boolean,nullable:boolean,enum:array<string>,low:double,high:double>>>"


def validate_activity(act: DataFrame, catalog: dict[str, dict[str, Field]] = CATALOG) -> DataFrame:
    """The rows with ``errors``, the messages of all rules each breaks; one pass of built-in expressions, no shuffle.

    A payload is parsed once. The catalogue is a constant in the plan, which has a place for each field of the activity with
    most of them, so it doesn't grow with the number of activities; what a place asks is compiled, not a function of a list.
    Where the rows have ``revenue_impact``, it must equal the amount of recognised revenue and be null for all else.
    """
    constant = json.dumps({activity: [{"name": name} | asdict(field) | {"enum": list(field.enum)} for name, field in fields.items()] for activity, fields in catalog.items()})
    places = range(max(len(fields) for fields in catalog.values()))
    given, fields, values = F.col("_given"), F.col("_fields"), F.col("_values")
    rows = act.withColumn("_given", F.coalesce(F.from_json("feature_json", "map<string,string>"), F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("_fields", F.try_element_at(F.from_json(F.lit(constant), RULES), F.col("activity")))
    value_of = lambda name: F.try_element_at(given, F.lit(name))
    rows = rows.withColumn("_values", F.array(*[F.try_element_at(given, F.get(fields, i)["name"]) for i in places]))

    def of_field(f: Column, value: Column) -> list[Column]:
        kind, there = f["kind"], value.isNotNull() | F.map_contains_key(given, f["name"])
        # One pattern or cast by the field's kind; a text is read as a number only where a bound asks for it, since a cast that fails is dear.
        malformed = F.when(kind == "string", False)
        for shape, pattern in SHAPES.items():
            malformed = malformed.when(kind == shape, ~value.rlike(pattern))
        for moment in ("date", "timestamp"):
            malformed = malformed.when(kind == moment, value.try_cast(moment).isNull())
        malformed = malformed.otherwise(False) | ((F.size(f["enum"]) > 0) & ~F.array_contains(f["enum"], value))
        beyond = lambda bound, test: F.when(bound.isNotNull(), test(value.try_cast("double")))
        broken = {
            "missing ": f["required"] & ~there, "null ": ~f["nullable"] & there & value.isNull(), "empty ": (kind == "string") & (F.trim(value) == ""),
            "bad ": value.isNotNull() & malformed, "low ": beyond(f["low"], lambda n: n < f["low"]), "high ": beyond(f["high"], lambda n: n > f["high"]),
        }
        return [F.when(condition, F.concat(F.lit(message), f["name"])) for message, condition in broken.items()]

    def ordered(low: str, high: str, kind: str) -> Column:
        return F.when(value_of(low).try_cast(kind) > value_of(high).try_cast(kind), "period order")

    unknown = F.size(F.array_except(F.map_keys(given), F.transform(fields, lambda f: f["name"]))) > 0
    money = lambda name: value_of(f"{name}_usd").try_cast("decimal(18,2)")
    only = lambda activity, condition, message: F.when((F.col("activity") == activity) & condition, message)
    rules = [
        ordered("period_start", "period_end", "date"), ordered("start", "end", "date"), ordered("interval_start", "interval_end", "timestamp"),
        only("usage_invoiced", money("gross") - money("discount") != money("net"), "invoice arithmetic"),
        only("usage_invoiced", money("channel_fee") > money("net"), "fee above net"),
        only("usage_invoiced", money("commit_applied") + money("cash_due") != money("net"), "commitment and cash"),
        only("usage_invoiced", value_of("contract_id").isNull() & (money("commit_applied") != 0), "drawdown without contract"),
        only("credit_issued", money("amount") <= 0, "credit without amount"),
    ]
    if "revenue_impact" in act.columns:
        owed = F.when(F.col("activity") == "revenue_recognized", money("net"))
        rules.append(F.when(~F.col("revenue_impact").eqNullSafe(owed), "revenue impact"))
    in_fields = [message for i in places for message in of_field(F.get(fields, i), F.get(values, i))]
    # Messages are joined and split again: a function over a list of them would evaluate each without compiled code.
    found = F.concat_ws("\n", F.when(unknown, "unknown field"), *in_fields, *rules)
    known = F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, "\n"))
    return rows.withColumn("errors", F.when(fields.isNull(), F.array(F.lit("unknown activity"))).otherwise(known)).drop("_given", "_fields", "_values")


def canonical_features(act: DataFrame, catalog: dict[str, dict[str, Field]] = CATALOG) -> DataFrame:
    """Payloads as JSON with sorted keys and typed values, each parsed once: money with two decimals, times in UTC to the
    microsecond, absent optional fields as null. Payloads of unknown activities stay as they are."""
    rows = act.withColumn("_given", F.from_json("feature_json", "map<string,string>"))

    def shown(name: str, kind: str) -> Column:
        value = F.try_element_at(F.col("_given"), F.lit(name)).try_cast(CASTS[kind])
        if kind == "timestamp":
            return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return value.cast("string") if kind in ("money", "date") else value

    text = F.when(F.lit(False), F.col("feature_json"))
    for activity, fields in catalog.items():
        packed = F.to_json(F.struct(*[shown(n, f.kind).alias(n) for n, f in sorted(fields.items())]), {"ignoreNullFields": "false"})
        text = text.when(F.col("activity") == activity, packed)
    return rows.withColumn("feature_json", text.otherwise(F.col("feature_json"))).drop("_given")


def inventory(observations: DataFrame) -> DataFrame:
    """(observation, status) of rows (observation, activity_id, content, sound): the first sound one of an id is accepted,
    the same content again is a duplicate, other content a conflict, and what isn't sound is rejected."""
    order = Window.partitionBy("activity_id").orderBy("observation")
    sound = observations.filter("sound").withColumns({"k": F.row_number().over(order), "first": F.first("content").over(order)})
    status = F.when(F.col("k") == 1, "accepted").when(F.col("content").eqNullSafe(F.col("first")), "duplicate").otherwise("conflict")
    return sound.select("observation", status.alias("status")).unionByName(observations.filter("NOT sound OR sound IS NULL").select("observation", F.lit("rejected").alias("status")))


def restore_check(act: DataFrame) -> DataFrame:
    """One row: whether positions are exactly 1 to n and ids are unique."""
    positions = act.agg(F.count(F.lit(1)).alias("n"), F.min("_stream_position").alias("low"), F.max("_stream_position").alias("high"), F.count_distinct("_stream_position").alias("positions"), F.count_distinct("activity_id").alias("ids"))
    whole = (F.col("n") == 0) | ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("positions") == F.col("n")) & (F.col("ids") == F.col("n")))
    return positions.select("n", whole.alias("complete"))


def pack_long(metric: str, rows: DataFrame, dimensions: list[str], units: dict[str, str]) -> DataFrame:
    """A metric as one row per dimension set and measure, with the value as text.

    Cents become dollars and their columns are named so, dimensions too. The status is the row's own where it has one; a
    measure without value is undefined.
    """
    dollars = lambda name: (F.col(name).cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")
    named = lambda name: name.removesuffix("_cents") + "_usd" if name.endswith("_cents") else name
    about = F.to_json(F.struct(*[(dollars(d) if d.endswith("_cents") else F.col(d)).alias(named(d)) for d in sorted(dimensions, key=named)]), {"ignoreNullFields": "false"})
    measures = F.array(*[F.struct(F.lit(named(n)).alias("measure"), (dollars(n) if u == "cents" else F.col(n).cast("string")).alias("value"), F.lit("USD" if u == "cents" else u).alias("unit")) for n, u in units.items()])
    own = F.col("status") if "status" in rows.columns else F.lit("defined")
    packed = rows.select(F.lit(metric).alias("metric"), about.alias("dimensions"), own.alias("status"), F.inline(measures))
    return packed.withColumn("status", F.when((F.col("status") == "defined") & F.col("value").isNull(), "undefined").otherwise(F.col("status")))
