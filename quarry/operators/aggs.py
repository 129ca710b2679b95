"""Aggregation operators (ops 34, 45-66).

All aggregates are algebraic or sketch-based (sum, count, min/max, max_by,
count_if, bool_and, percentile_approx), so Spark runs a partial aggregate in
every map task and a hot key reaches the reducer as one partial row per
task.  ``count_distinct`` is rewritten by Catalyst into a two-level
aggregate that is also partial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage
from quarry.functions import scalars as S
from quarry.operators.windows import SEGMENT_ROWS, range_segments, segmented_running


# ---------------------------------------------------------------- op 34
def error_class(df: DataFrame, msg: str, rules: Sequence[tuple[str, str]], top_k: int,
                out: str = "error_class") -> DataFrame:
    """Op 34: ordered regex rules give a class; only the ``top_k`` most
    frequent classes are kept, everything else becomes ``other``.

    The frequency table has one row per rule class (bounded by the rules).
    """
    d = df.withColumn("_cls", S.error_rule_class(msg, rules))
    freq = d.groupBy("_cls").agg(F.count(F.lit(1)).alias("_n"))
    top = (freq.filter(F.col("_cls") != "other").orderBy(F.col("_n").desc(), F.col("_cls").asc())
           .limit(top_k).select("_cls", F.lit(True).alias("_keep")))
    return (d.join(top, "_cls", "left")
            .withColumn(out, F.when(F.col("_keep"), F.col("_cls")).otherwise(F.lit("other")))
            .drop("_cls", "_keep"))


# ---------------------------------------------------------------- review (45-48)
SEVERITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def severity_rank(col) -> Column:
    c = F.upper(F.col(col) if isinstance(col, str) else col)
    out = F.lit(0)
    for k, v in SEVERITY_RANK.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def review_score(checks: DataFrame, agents: DataFrame, change: str = "change_id",
                 agent: str = "agent_no", verdict: str = "verdict") -> DataFrame:
    """Op 45: per change sum(w * pass) / sum(w) over enabled agents, plus the
    facts op 46 needs (worst severity, required agents all passed)."""
    a = agents.filter("enabled")
    j = checks.join(a, agent)
    passed = (F.col(verdict) == "PASS").cast("double")
    return j.groupBy(change).agg(
        F.try_divide(F.sum(F.col("weight") * passed), F.sum("weight")).alias("score"),
        F.count(F.lit(1)).alias("n_checks"),
        F.max(severity_rank("severity")).alias("max_severity"),
        F.coalesce(F.bool_and(F.when(F.col("required"), F.col(verdict) == "PASS")),
                   F.lit(True)).alias("required_pass"))


def review_decision(scores: DataFrame, merge_at: float = 0.75, block_below: float = 0.50) -> DataFrame:
    """Op 46: BLOCK (score < .50, critical issue, required agent failed),
    else MERGE (score >= .75, no high/critical issue, required all pass),
    else REVIEW - evaluated in that order."""
    sev = F.col("max_severity")
    d = (F.when((F.col("score") < block_below) | (sev >= SEVERITY_RANK["CRITICAL"])
                | ~F.col("required_pass"), F.lit("BLOCK"))
         .when((F.col("score") >= merge_at) & (sev < SEVERITY_RANK["HIGH"])
               & F.col("required_pass"), F.lit("MERGE"))
         .otherwise(F.lit("REVIEW")))
    return scores.withColumn("decision", d)


def risk_level(facts: DataFrame) -> DataFrame:
    """Op 47: risk from per-change facts ``security_failed, critical_files,
    n_fail, pass_share, complexity, prod_change, test_change``:
    CRITICAL security failed; HIGH critical files with failures, or
    complexity 4 with failures; MEDIUM complexity 3 or several failures;
    LOW when at least 2/3 of the checks pass; else MEDIUM.  A production
    change without a test change blocks auto-merge; so does the policy of the
    risk class: CRITICAL and HIGH never, MEDIUM only when all checks pass, LOW
    when at least 2/3 do."""
    fails = F.col("n_fail") > 0
    r = (F.when(F.col("security_failed"), F.lit("CRITICAL"))
         .when((F.col("critical_files") & fails) | ((F.col("complexity") == 4) & fails), F.lit("HIGH"))
         .when((F.col("complexity") == 3) | (F.col("n_fail") > 1), F.lit("MEDIUM"))
         .when(F.col("pass_share") >= 2.0 / 3.0, F.lit("LOW"))
         .otherwise(F.lit("MEDIUM")))
    return (facts.withColumn("risk", r)
            .withColumn("auto_merge_blocked", F.col("prod_change") & ~F.col("test_change"))
            .withColumn("auto_merge_allowed", ~F.col("auto_merge_blocked") & (
                F.when(F.col("risk") == "LOW", F.col("pass_share") >= 2.0 / 3.0)
                .when(F.col("risk") == "MEDIUM", F.col("pass_share") >= 1.0).otherwise(F.lit(False)))))


def review_metrics(checks: DataFrame, dims: Sequence[str], verdict: str = "verdict",
                   confidence: str = "confidence", elapsed: str | None = None) -> DataFrame:
    """Op 48: totals and per-dimension counts in one pass (GROUPING SETS:
    one Expand, one shuffle).  ``dimension`` names the grouping, ``key`` its
    value; the total row has dimension ``total``.  With the column ``elapsed``
    also its least, average and largest value."""
    times = [] if elapsed is None else [F.min(elapsed).alias("min_time"), F.avg(elapsed).alias("avg_time"),
                                        F.max(elapsed).alias("max_time")]
    sets = [[d] for d in dims] + [[]]
    g = checks.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(verdict) == "PASS").alias("n_pass"),
        F.count_if(F.col(verdict) == "FAIL").alias("n_fail"),
        F.avg(confidence).alias("avg_confidence"), *times,
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = F.lit("total")
    key = F.lit(None).cast("string")
    for d in reversed(dims):
        dim = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dim)
        key = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(key)
    return g.select(dim.alias("dimension"), key.alias("key"), "n", "n_pass", "n_fail",
                    F.try_divide(F.col("n_pass"), F.col("n")).alias("success_rate"),
                    "avg_confidence", *(["min_time", "avg_time", "max_time"] if times else []))


#: Files that one task of :func:`review_files` groups by change.
FILES_PER_TASK = 400_000


def review_files(files: DataFrame, change: str = "change_id", language: str = "language",
                 kind: str = "kind", n_files: int | None = None) -> DataFrame:
    """Op 48 (file level): number of files and of changes per language, per
    kind (test, config, production) and in total.  Changes are counted after
    each (change, language, kind) became one row, so a file type that every
    change holds reaches a reducer as partial counts.

    The files are dealt by change over parts of about ``FILES_PER_TASK`` rows
    (``n_files``: their number, or an upper bound that saves a count), so the
    tables that a task groups by change stay of one size as the input grows."""
    n = files.count() if n_files is None else n_files
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select(change, language, kind).repartition(max(least, -(-n // FILES_PER_TASK)), change)
    cells = dealt.groupBy(change, language, kind).agg(F.count(F.lit(1)).alias("_n"))
    sets = [("language", F.col(language)), ("kind", F.col(kind)), ("total", F.lit(None).cast("string"))]
    per = (cells.select(change, "_n", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("key"))
                                                          for d, c in sets])).alias("_s"))
           .groupBy(change, "_s").agg(F.sum("_n").alias("_n")))
    return per.groupBy(F.col("_s.dimension").alias("dimension"), F.col("_s.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n_changes"), F.sum("_n").alias("n_files"))


def review_rollup(changes: DataFrame, dims: Sequence[str], decision: str = "decision",
                  level: str = "complexity") -> DataFrame:
    """Op 48 (change level): number of changes, auto-merge rate and average
    complexity level per complexity level, per risk class and in total, in
    one GROUPING SETS aggregate over the per-change facts."""
    changes = changes.withColumn("_level", F.col(level))      # averaged where it is no group either
    sets = [[d] for d in dims] + [[]]
    g = changes.groupingSets(sets, *dims).agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.count_if(F.col(decision) == "MERGE").alias("n_merge"), F.avg("_level").alias("avg_complexity"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = F.lit("total")
    key = F.lit(None).cast("string")
    for d in reversed(dims):
        dim = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dim)
        key = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(key)
    return g.select(dim.alias("dimension"), key.alias("key"), "n_changes", "n_merge",
                    (F.col("n_merge") / F.col("n_changes")).alias("auto_merge_rate"), "avg_complexity")


# ---------------------------------------------------------------- op 49
def latency_percentiles(df: DataFrame, by: str | Sequence[str], value: str,
                        ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Op 49: exact p50/p95/p99 per group: the smallest value whose rank
    reaches p*n.

    Distinct values are counted per group and range-partitioned on (group,
    value); a value's rank is the count of its group in the ranges before
    plus the running count inside its range, so a hot group is spread over
    many tasks.  The counts are written once, so ranges and ranks agree.
    """
    keys = [by] if isinstance(by, str) else list(by)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hist = cut_lineage(hist.repartitionByRange(n_ranges, *keys, value)
                       .withColumn("_r", F.spark_partition_id()))
    part = hist.groupBy(*keys, "_r").agg(F.sum("_c").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_r")       # one row per range of a group
    part = part.select(*keys, "_r", F.sum("_n").over(Window.partitionBy(*keys)).alias("n"),
                       (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    running = F.sum("_c").over(Window.partitionBy(*keys, "_r").orderBy(value))
    ranked = (hist.withColumn("_run", running).join(part, [*keys, "_r"])
              .withColumn("_rank", F.col("_run") + F.col("_before")))
    cols = [F.min(F.when(F.col("_rank") >= F.ceil(F.lit(p) * F.col("n")), F.col(value)))
            .alias(f"p{int(round(p * 100))}") for p in ps]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *cols)


def latency_percentiles_approx(df: DataFrame, by: str | Sequence[str], value: str,
                               ps: Sequence[float] = (0.5, 0.95, 0.99),
                               accuracy: int = 10_000) -> DataFrame:
    """Op 49 with a mergeable quantile sketch: one shuffle of bounded
    summaries; ranks are off by at most n/accuracy."""
    keys = [by] if isinstance(by, str) else list(by)
    q = F.percentile_approx(value, list(ps), accuracy)
    out = df.groupBy(*keys).agg(q.alias("_q"), F.count(value).alias("n"))
    cols = [F.col("_q")[i].alias(f"p{int(round(p * 100))}") for i, p in enumerate(ps)]
    return out.select(*keys, "n", *cols)


# ---------------------------------------------------------------- fleet (50-52)
def probe_status(code) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return (F.when((c >= 200) & (c < 300), F.lit("ok"))
            .when((c >= 400) & (c < 500), F.lit("degraded")).otherwise(F.lit("offline")))


STATUS_RANK = {"up": 0, "degraded": 1, "down": 2}


def role_health(probes: DataFrame, roles: DataFrame, role: str = "role",
                instance: str = "instance", code: str = "code", ts: str = "ts") -> DataFrame:
    """Op 50: the latest probe per instance gives ok/degraded/offline; a role
    is up when its ok instances reach ``min_healthy``, degraded when some
    instance answers, else down.  Roles without probes count as down unless
    ``min_healthy`` is 0."""
    latest = probes.groupBy(role, instance).agg(F.max_by(code, F.struct(ts, instance)).alias("_c"))
    st = latest.withColumn("_s", probe_status("_c"))
    per = st.groupBy(role).agg(F.count_if(F.col("_s") == "ok").alias("n_ok"),
                               F.count_if(F.col("_s") == "degraded").alias("n_degraded"),
                               F.count_if(F.col("_s") == "offline").alias("n_offline"))
    j = roles.join(per, role, "left").fillna(0, ["n_ok", "n_degraded", "n_offline"])
    status = (F.when(F.col("n_ok") >= F.col("min_healthy"), F.lit("up"))
              .when(F.col("n_ok") + F.col("n_degraded") > 0, F.lit("degraded"))
              .otherwise(F.lit("down")))
    return j.withColumn("status", status)


def capability_rollup(role_status: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Op 51: capability status = worst status of its required, non-optional
    member roles (a capability of optional roles only is up)."""
    m = capabilities.select("capability", F.explode("roles").alias("role"))
    rs = role_status.select("role", "optional", "status")
    j = m.join(rs, "role", "left").withColumn(
        "_r", F.when(F.col("optional"), F.lit(0)).otherwise(
            F.coalesce(F.element_at(F.create_map(*[x for kv in STATUS_RANK.items()
                                                   for x in map(F.lit, kv)]), F.col("status")),
                       F.lit(STATUS_RANK["down"]))))
    worst = j.groupBy("capability").agg(F.max("_r").alias("_w"))
    inv = {v: k for k, v in STATUS_RANK.items()}
    status = F.lit("down")
    for v in sorted(inv, reverse=True):
        status = F.when(F.col("_w") == v, F.lit(inv[v])).otherwise(status)
    return worst.select("capability", status.alias("status"))


def service_verdicts(services: DataFrame, expected: DataFrame, service: str = "service") -> DataFrame:
    """Op 52, service rows: every service with its ``mark`` ok / warn / FAIL / cold.

    Running: healthy or no health -> ok, starting -> warn, else FAIL.  Not
    running: FAIL when the topology expects the service, else cold.  Warn
    count includes cold services.
    """
    s = services.join(expected.select(service, F.lit(True).alias("_exp")), service, "left")
    running = F.col("state") == "running"
    h = F.coalesce(F.col("health"), F.lit(""))
    mark = (F.when(running & ((h == "healthy") | (h == "")), F.lit("ok"))
            .when(running & (h == "starting"), F.lit("warn"))
            .when(running, F.lit("FAIL"))
            .when(F.coalesce(F.col("_exp"), F.lit(False)), F.lit("FAIL"))
            .otherwise(F.lit("cold")))
    return s.withColumn("mark", mark).drop("_exp")


def fleet_verdict(services: DataFrame, expected: DataFrame, host: str = "host",
                  service: str = "service") -> DataFrame:
    """Op 52, host rows: red when any service of the host is marked FAIL."""
    return service_verdicts(services, expected, service).groupBy(host).agg(
        F.bool_or(F.col("mark") == "FAIL").alias("red"),
        F.count_if(F.col("mark").isin("warn", "cold")).alias("warns"),
        F.count_if(F.col("mark") == "ok").alias("oks"),
        F.count(F.lit(1)).alias("services"))


# ---------------------------------------------------------------- 53, 54
def status_pivot(steps: DataFrame, target: str, status: str) -> DataFrame:
    """Op 53: PASS / FAIL / SKIP counts per target plus a total row (rollup);
    anything else than PASS or FAIL counts as SKIP; green iff no FAIL."""
    s = steps.withColumn("_st", F.when(F.col(status).isin("PASS", "FAIL"), F.col(status))
                         .otherwise(F.lit("SKIP")))
    g = s.rollup(target).agg(*[F.count_if(F.col("_st") == k).alias(k.lower())
                               for k in ("PASS", "FAIL", "SKIP")])
    return (g.withColumn(target, F.coalesce(F.col(target).cast("string"), F.lit("TOTAL")))
            .withColumn("green", F.col("fail") == 0))


def duplicates(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Op 54: keys occurring more than once, with their count."""
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# ---------------------------------------------------------------- budget (55-56)
def budget_usage(calls: DataFrame, providers: DataFrame, provider: str = "provider_no",
                 ts: str = "ts", tokens: str = "tokens", reset_hour: int = 0) -> DataFrame:
    """Op 55: tokens per provider per day (reset at ``reset_hour`` UTC) and
    per ISO week (Monday), against the limits; limit 0 = unlimited; cost =
    tokens / 1e6 * price.  One row per provider and day."""
    t = F.col(ts) - F.expr(f"INTERVAL {reset_hour} HOURS")
    c = calls.select(provider, tokens, F.to_date(t).alias("day"))
    daily = c.groupBy(provider, "day").agg(F.sum(tokens).alias("tokens_day"))
    daily = daily.withColumn("week", F.date_trunc("week", F.col("day")).cast("date"))
    weekly = daily.groupBy(provider, "week").agg(F.sum("tokens_day").alias("tokens_week"))
    j = daily.join(weekly, [provider, "week"]).join(providers, provider)
    return j.select(
        provider, "provider", "day", "week", "tokens_day", "tokens_week",
        ((F.col("daily_limit") > 0) & (F.col("tokens_day") > F.col("daily_limit"))).alias("over_daily"),
        ((F.col("weekly_limit") > 0) & (F.col("tokens_week") > F.col("weekly_limit")))
        .alias("over_weekly"),
        (F.col("tokens_day") * F.col("cost_per_m_token")).alias("cost_micro_usd"))


PRIORITY_LEVEL = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium",
                  "4-NOT SPECIFIED": "low", "5-LOW": "low"}


def route_provider(tasks: DataFrame, usage: DataFrame, providers: Sequence[tuple],
                   day: str = "day", priority: str = "priority") -> DataFrame:
    """Op 56: per task the strongest provider that still has room in both
    its daily and weekly limit on the task's day (limit 0 = unlimited);
    otherwise the unlimited local tier.  The model is ``provider:level`` by
    task priority.

    ``providers`` is the configuration list ``(provider_no, provider, tier,
    strength)``; it is expanded per day from a literal array (no join with a
    data-sized side), then joined with the per-day usage on the equi-key.
    """
    lit_arr = F.array(*[F.struct(F.lit(p[0]).alias("provider_no"), F.lit(p[1]).alias("provider"),
                                 F.lit(p[2]).alias("tier"), F.lit(p[3]).alias("strength"))
                        for p in providers])
    days = tasks.select(day).distinct()
    cand = days.select(day, F.explode(lit_arr).alias("_p")).select(day, "_p.*")
    room = usage.select("provider_no", day,
                        (~F.col("over_daily") & ~F.col("over_weekly")).alias("_room"))
    cand = cand.join(room, ["provider_no", day], "left").filter(F.coalesce("_room", F.lit(True)))
    w = Window.partitionBy(day).orderBy(F.col("strength").desc(), F.col("provider_no"))
    pick = (cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select(day, "provider", "tier"))
    lvl = F.lit("low")
    for k, v in PRIORITY_LEVEL.items():
        lvl = F.when(F.col(priority) == k, F.lit(v)).otherwise(lvl)
    out = tasks.join(pick, day, "left").withColumn("provider", F.coalesce("provider", F.lit("local")))
    return out.withColumn("model", F.concat_ws(":", "provider", lvl))


# ---------------------------------------------------------------- op 57
def gpu_inventory(rows: DataFrame, host: str, line: str, order: str) -> DataFrame:
    """Op 57: parse ``model, driver, vram_mb`` lines per host.  Model and
    driver come from the first line (by ``order``; empty when it has fewer
    than 3 fields), lines with at least 3 fields count as cards, and VRAM is
    the least positive whole number of MB in GB, rounded half to even (0
    without one); ``n_bad`` counts cards whose VRAM is no whole number."""
    parts = F.transform(F.split(F.trim(line), ","), lambda x: F.trim(x))
    r = rows.filter(F.trim(line) != "").select(host, order, parts.alias("_p"))
    r = r.withColumn("_ok", F.size("_p") >= 3)
    mb = F.when(F.col("_ok") & F.get("_p", F.lit(2)).rlike(r"^[+-]?[0-9]+$"),
                F.get("_p", F.lit(2)).try_cast("long"))
    first = F.min_by(F.struct("_ok", F.get("_p", F.lit(0)).alias("m"), F.get("_p", F.lit(1)).alias("d")), order)
    r = r.withColumn("_mb", mb)
    g = r.groupBy(host).agg(
        first.alias("_f"), F.count_if("_ok").alias("n_cards"),
        F.min(F.when(F.col("_mb") > 0, F.col("_mb"))).alias("_min"),
        F.count_if(F.col("_ok") & F.col("_mb").isNull()).alias("n_bad"))
    return g.select(host, F.when(F.col("_f._ok"), F.col("_f.m")).otherwise(F.lit("")).alias("model"),
                    F.when(F.col("_f._ok"), F.col("_f.d")).otherwise(F.lit("")).alias("driver"), "n_cards",
                    F.coalesce(F.bround(F.col("_min") / 1024.0).cast("long"), F.lit(0)).alias("vram_gb"), "n_bad")


# ---------------------------------------------------------------- ledger (58-60)
# Signed effect of each journal operation on (available, locked, reserve).
LEDGER_EFFECT = {
    "deposit": (1, 0, 0), "withdraw": (-1, 0, 0), "lock": (-1, 1, 0),
    "release_return": (1, -1, 0), "release_slash": (0, -1, 1),
    "settle_paid": (1, 0, 0), "settle_tax": (0, 0, 1),
}


def _effect(op: str, i: int) -> Column:
    out = F.lit(0)
    for k, v in LEDGER_EFFECT.items():
        out = F.when(F.col(op) == k, F.lit(v[i])).otherwise(out)
    return out


def ledger_balances(journal: DataFrame, node: str = "node", op: str = "op",
                    amount: str = "amount") -> DataFrame:
    """Op 58: per node available, locked and the reserve credited from the
    node's jobs (slashes and taxes)."""
    a = F.col(amount)
    return journal.groupBy(node).agg(
        F.sum(_effect(op, 0) * a).alias("available"), F.sum(_effect(op, 1) * a).alias("locked"),
        F.sum(_effect(op, 2) * a).alias("reserve"))


def ledger_invariant(journal: DataFrame, op: str = "op", amount: str = "amount") -> DataFrame:
    """Op 59: available + locked + reserve = deposits - withdrawals + settled
    value (settle_paid + settle_tax).  One row with both sides and the flag."""
    a = F.col(amount)
    g = journal.agg(
        F.sum((_effect(op, 0) + _effect(op, 1) + _effect(op, 2)) * a).alias("held"),
        F.sum(F.when(F.col(op) == "deposit", a).when(F.col(op) == "withdraw", -a)
              .when(F.col(op).isin("settle_paid", "settle_tax"), a).otherwise(0)).alias("expected"))
    return g.withColumn("holds", F.col("held") == F.col("expected"))


def settlement_rollup(settlements: DataFrame, worker: str = "worker", pool: str = "pool") -> DataFrame:
    """Op 60: gross, taxes and paid per (pool, worker), per pool and in total
    (ROLLUP); reserve growth = network + pool tax."""
    g = settlements.rollup(pool, worker).agg(
        F.sum("value").alias("gross"), F.sum("network_tax").alias("network_tax"),
        F.sum("pool_tax").alias("pool_tax"), F.sum("paid").alias("paid"),
        F.count(F.lit(1)).alias("n_jobs"))
    return g.withColumn("reserve_growth", F.col("network_tax") + F.col("pool_tax"))


# ---------------------------------------------------------------- pools, reputation (61-64)
def _axis_tier(c: Column, bounds: Sequence[float]) -> Column:
    return (F.when(c <= bounds[0], 2).when(c <= bounds[1], 3).when(c <= bounds[2], 4)
            .otherwise(5))


# Tier bounds per axis (stake and volume in USD, members).
TIER_STAKE = (10_000, 100_000, 1_000_000)
TIER_MEMBERS = (50, 500, 5000)
TIER_VOLUME = (1_000, 10_000, 100_000)


def pool_tier(pools: DataFrame, stake: str = "total_stake", members: str = "members",
              volume: str = "volume", kyc_param: str | None = None) -> DataFrame:
    """Op 61: tier = max over the axes; a solo pool (1 member, no volume, no
    stake) is tier 1; KYC is required from tier 3 or when the pool asks."""
    solo = (F.col(members) <= 1) & (F.col(volume) == 0) & (F.col(stake) == 0)
    t = F.greatest(_axis_tier(F.col(stake), TIER_STAKE), _axis_tier(F.col(members), TIER_MEMBERS),
                   _axis_tier(F.col(volume), TIER_VOLUME))
    tier = F.when(solo, F.lit(1)).otherwise(t)
    kyc = tier >= 3
    if kyc_param:
        kyc = kyc | F.col(kyc_param)
    return pools.withColumn("tier", tier).withColumn("kyc_required", kyc)


SOLO_CAP = 100
UNITS_PER_REP = 1_000_000


def effective_rep_cap(reps: DataFrame) -> DataFrame:
    """Op 62: pooled earned + endorsement, solo min(earned, 100); then at most
    floor(donated / 1e6)."""
    raw = F.when(F.col("pooled"), F.col("earned") + F.col("endorsement")).otherwise(
        F.least(F.col("earned"), F.lit(SOLO_CAP).cast("long")))
    cap = F.least(raw, F.floor(F.col("donated") / UNITS_PER_REP).cast("long"))
    return reps.withColumn("rep_cap", cap)


def quorum_outcomes(posts: DataFrame, sigs: DataFrame, registered: DataFrame, post: str,
                    signer: str, m: int) -> DataFrame:
    """Op 63: outcomes signed by at least m distinct registered verifiers."""
    s = sigs.join(registered.select(signer), signer, "left_semi")
    cnt = s.groupBy(post).agg(F.count_distinct(signer).alias("signers"))
    return posts.join(cnt.filter(F.col("signers") >= m), post)


def credit_policy_check(policies: DataFrame, min_donation: int) -> DataFrame:
    """Op 64: a policy is rejected when 2 * per-node maximum > minimum donation."""
    return policies.withColumn("rejected", F.col("per_node_max") * 2 > F.lit(min_donation))


# ---------------------------------------------------------------- 65, 66
def prefix_rollup(df: DataFrame, keys: Sequence[str], distinct_of: str) -> DataFrame:
    """Op 65: counts per prefix hierarchy (ROLLUP over ``keys``) with an exact
    and a sketch-based distinct count side by side."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"),
                                F.count_distinct(distinct_of).alias("n_distinct"),
                                F.approx_count_distinct(distinct_of).alias("n_distinct_approx"))


def elite_archive(programs: DataFrame, cell: Sequence[str], fitness: str, pid: str) -> DataFrame:
    """Op 66: MAP-Elites archive, the best program per behaviour cell (ties to
    the smaller id)."""
    return programs.groupBy(*cell).agg(
        F.max_by(F.struct(F.col(fitness).alias("fitness"), (-F.col(pid)).alias("_nid")),
                 F.struct(F.col(fitness), -F.col(pid))).alias("_b"),
        F.count(F.lit(1)).alias("n_programs")).select(
        *cell, F.col("_b.fitness").alias("fitness"), (-F.col("_b._nid")).alias(pid), "n_programs")


def elite_progress(programs: DataFrame, cell: Sequence[str], fitness: str,
                   generation: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Op 66: per generation the best fitness, the running best and the
    archive coverage (cells filled so far), by segments of ``segment_rows``
    generations."""
    first_seen = programs.groupBy(*cell).agg(F.min(generation).alias(generation))
    cov = first_seen.groupBy(generation).agg(F.count(F.lit(1)).alias("_new_cells"))
    best = programs.groupBy(generation).agg(F.max(fitness).alias("best_fitness"))
    g = best.join(cov, generation, "left").fillna(0, ["_new_cells"])
    cut = range_segments(g, [generation], segment_rows).withColumn("_all", F.lit(0))
    run = segmented_running(cut, "_all", [generation], F.col("_segment"), {"coverage": F.col("_new_cells")},
                            largest={"running_best": F.col("best_fitness")})
    return run.select(generation, "best_fitness", "running_best", "coverage")
