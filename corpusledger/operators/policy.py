"""Politeness, quotas, budgets, robots rules, schedules and blackout windows."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the adaptive slowdown.
WARM_UP, RATIO, MOST, FAST, SLOW = 5, 2.0, 8.0, 0.3, 0.01
#: Names of days, and the range of each field of a cron expression.
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
CRON_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
DAY_NUMBER = {name: number for number, name in enumerate(DAYS)}
DAY, WEEK = 1440, 7 * 1440
CRON_ITEM = re.compile(r"(?:(?P<all>\*)|(?P<first>\d+)(?:-(?P<last>\d+))?)(?:/(?P<step>\d+))?")
CLOCK = re.compile(r"([01]?\d|2[0-3]):([0-5]\d)")
ROBOTS_LINE = re.compile(r"(?m)^[ \t]*([^:#\r\n]+?)[ \t]*:([^#\r\n]*)")


def request_pressure(requests: DataFrame, host: str, at: str, key: str, quota: int = 60, delay_ms: int = 1000) -> DataFrame:
    """Requests of the host in the last 60 s, whether that passes the quota, and the wait politeness asks for."""
    millis = F.unix_millis(F.col(at).cast("timestamp"))
    rows = requests.withColumn("_ms", millis)
    minute = Window.partitionBy(host).orderBy("_ms").rangeBetween(-59_999, 0)
    before = Window.partitionBy(host).orderBy("_ms", key)
    gap = F.col("_ms") - F.lag("_ms").over(before)
    return (
        rows.withColumn("in_minute", F.count(F.lit(1)).over(minute))
        .withColumn("over_quota", F.col("in_minute") > quota)
        .withColumn("wait_ms", F.coalesce(F.greatest(F.lit(0), delay_ms - gap), F.lit(0)).cast("long"))
        .drop("_ms")
    )


def slowdown(samples: DataFrame, host: str, order: Sequence[str], latency: str) -> DataFrame:
    """Slowdown factor of each host after its samples: two moving averages, a recurrence in order.

    A host's samples stream past in order and only the two averages are kept, so a host of any length needs no memory.
    Samples without a latency are passed over.
    """
    rows = samples.filter(F.col(latency).isNotNull()).select(host, *order, F.col(latency).cast("double").alias("_latency"))
    schema = f"{host} {dict(samples.dtypes)[host]}, samples int, fast double, baseline double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, fast, base, names, kept = None, 0, 0.0, 0.0, [host, "samples", "fast", "baseline"], []
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, x in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if n and name != current:
                    kept.append((current, n, fast, base))
                    n = 0
                alpha = FAST if x < base else SLOW
                fast, base = (FAST * x + (1 - FAST) * fast, alpha * x + (1 - alpha) * base) if n else (x, x)
                current, n = name, n + 1
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (kind, pa.int32(), pa.float64(), pa.float64()), strict=True)], names)
                kept = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([n], pa.int32()), pa.array([fast]), pa.array([base])], names)

    folded = rows.repartition(host).sortWithinPartitions(host, *order).mapInArrow(run, schema)
    ratio = F.col("fast") / F.col("baseline")
    calm = (F.col("samples") < WARM_UP) | (F.col("baseline") <= 0) | (ratio <= RATIO)
    return folded.withColumn("factor", F.when(calm, 1.0).otherwise(F.least(ratio, F.lit(MOST))))


def breaker(outcomes: DataFrame, host: str, at_ms: str, failed: str, key: str, threshold: int = 5, cooldown_ms: int = 60_000) -> DataFrame:
    """State of the host's circuit breaker as each request meets it, and whether the request is let through.

    Refused requests have no outcome, so each state hangs on the one before. A host's requests stream past in order, batch
    by batch, with two numbers kept between them: the failures in a row and the time of opening.
    """
    types = dict(outcomes.dtypes)
    schema = f"{host} {types[host]}, {at_ms} long, {key} {types[key]}, state string, allowed boolean"
    rows = outcomes.select(host, F.col(at_ms).cast("long").alias(at_ms), key, F.coalesce(F.col(failed), F.lit(False)).cast("boolean").alias("_failed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, in_a_row, opened = object(), 0, None
        for batch in batches:
            states = []
            hosts, times, bad = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for name, now, is_bad in zip(hosts, times, bad, strict=True):
                if name != current:
                    current, in_a_row, opened = name, 0, None
                waits = opened is not None and now - opened < cooldown_ms
                states.append("open" if waits else "closed" if opened is None else "half-open")
                if not waits:
                    in_a_row = in_a_row + 1 if is_bad else 0
                    opened = now if in_a_row >= threshold else None
            named = [*batch.columns[:3], pa.array(states, pa.string()), pa.array([s != "open" for s in states], pa.bool_())]
            yield pa.RecordBatch.from_arrays(named, [host, at_ms, key, "state", "allowed"])

    return rows.repartition(host).sortWithinPartitions(host, at_ms, key).mapInArrow(run, schema)


def within_budget(steps: DataFrame, run: str, order: Sequence[str], size: str, elapsed_ms: str | None = None, requests: int = 10_000, most_bytes: int = 10 * 2**30, duration_ms: int = 6 * 3_600_000) -> DataFrame:
    """Steps before any part of the run's budget is passed."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("requests", F.row_number().over(Window.partitionBy(run).orderBy(*order))).withColumn("bytes", F.sum(size).over(w))
    ok = (F.col("requests") <= requests) & (F.col("bytes") <= most_bytes)
    if elapsed_ms is not None:
        ok = ok & (F.col(elapsed_ms) <= duration_ms)
    return out.filter(ok)


class Rule(NamedTuple):
    """One line of a robots file: the agents of its group, whether it allows, and its pattern."""

    group: int
    agents: tuple[str, ...]
    allows: bool
    pattern: str


def parse_robots(text: str) -> list[Rule]:
    """The rule table. A group begins where an agent follows something else; a group without rules has one empty Allow."""
    lines = [m.groups() for m in ROBOTS_LINE.finditer(text)]
    fields = [(name.strip().lower(), value.strip()) for name, value in lines]
    is_agent = [name == "user-agent" for name, _ in fields]
    group = list(itertools.accumulate(now and not before for before, now in zip([False, *is_agent], is_agent, strict=False)))
    agents: dict[int, list[str]] = {}
    for number, (_, value) in itertools.compress(zip(group, fields, strict=True), is_agent):
        agents.setdefault(number, []).append(value.lower())
    rules = [Rule(n, tuple(agents[n]), name == "allow", value) for n, (name, value) in zip(group, fields, strict=True) if n and name in ("allow", "disallow")]
    bare = [Rule(n, tuple(names), True, "") for n, names in agents.items() if n not in {r.group for r in rules}]
    return sorted([*rules, *bare], key=lambda r: r.group)


def path_pattern(pattern: str, to_end: bool = False) -> str:
    """A pattern of a robots file as a regular expression: pieces between stars are found from left to right and not sought again.

    ``to_end``: the piece before a closing ``$`` is sought at the end of the path, as RFC 9309 has it, not at its first place.
    """
    body, end = (pattern[:-1], r"\z") if pattern.endswith("$") else (pattern, "")
    first, *others = (re.escape(piece) for piece in body.split("*"))
    if to_end and end and others:
        end = f".*{others.pop()}{end}"
    return f"(?s)^{first}{''.join(f'(?>.*?{piece})' for piece in others if piece)}{end}"


def robots_allowed(path: Column, rules: Sequence[Rule], agent: str, to_end: bool = False) -> Column:
    """The longest rule that matches decides, an Allow among equals: one maximum over the rules of the agent's group.

    The group is the first that names a part of the agent, else the first for all; an empty Disallow allows all. ``to_end`` as in :func:`path_pattern`.
    """
    agent = agent.lower()
    named = [r.group for r in rules if any(a != "*" and a in agent for a in r.agents)] or [r.group for r in rules if "*" in r.agents]
    own = [r for r in rules if named and r.group == named[0]]
    if any(not r.allows and not r.pattern for r in own):
        return F.lit(True)
    matched = [F.when(path.rlike(path_pattern(r.pattern, to_end)), F.struct(F.lit(len(r.pattern)), F.lit(r.allows).alias("allows"))) for r in own if r.pattern]
    return F.coalesce(F.array_max(F.array(*matched))["allows"], F.lit(True)) if matched else F.lit(True)


def parse_cron(expression: str) -> list[int]:
    """Bit sets of the minutes, hours, days of month, months and days of week (0 is Sunday) that are due."""
    parts = expression.split()
    if len(parts) != len(CRON_FIELDS):
        raise ValueError("cron needs five fields")
    sets = []
    for part, (low, high) in zip(parts, CRON_FIELDS, strict=True):
        bits = 0
        for item in part.split(","):
            m = CRON_ITEM.fullmatch(item)
            if not m:
                raise ValueError(f"cron field cannot be read: {item!r}")
            first = low if m["all"] else int(m["first"])
            last = high if m["all"] or (m["step"] and not m["last"]) else int(m["last"] or first)
            step = int(m["step"] or 1)
            if not (low <= first <= last <= high and step):
                raise ValueError(f"cron field out of range: {item!r}")
            bits |= sum(1 << value for value in range(first, last + 1, step))
        sets.append(bits)
    return sets


def _either_day(days: int, weekdays: int) -> bool:
    """Where both day fields are restricted either is enough."""
    return days.bit_count() < 31 and weekdays.bit_count() < 7


def cron_matches(ts: Column, expression: str) -> Column:
    """Whether the minute is due: a bit of each set."""
    minutes, hours, days, months, weekdays = parse_cron(expression)
    has = lambda bits, at: F.getbit(F.lit(bits).cast("long"), at) == 1
    day, weekday = has(days, F.dayofmonth(ts)), has(weekdays, F.dayofweek(ts) - 1)
    return has(minutes, F.minute(ts)) & has(hours, F.hour(ts)) & has(months, F.month(ts)) & ((day | weekday) if _either_day(days, weekdays) else (day & weekday))


def next_due(expression: str, after: datetime, days: int = 4 * 366) -> datetime | None:
    """The next due minute, within four years: days first, then the minutes of the first that fits."""
    minutes, hours, month_days, months, weekdays = parse_cron(expression)
    combine = any if _either_day(month_days, weekdays) else all
    start = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    clock = [hour * 60 + minute for hour in range(24) if hours >> hour & 1 for minute in range(60) if minutes >> minute & 1]
    for offset in range(days + 1):
        midnight = start.replace(hour=0, minute=0) + timedelta(days=offset)
        if not months >> midnight.month & 1 or not combine((month_days >> midnight.day & 1, weekdays >> midnight.isoweekday() % 7 & 1)):
            continue
        at = bisect.bisect_left(clock, 0 if offset else start.hour * 60 + start.minute)
        if at < len(clock):
            return midnight + timedelta(minutes=clock[at])
    return None


def cron_bits(field: Column, low: int, high: int) -> Column:
    """The bit set of one field as a column; null where it cannot be read."""

    def item(x: Column) -> Column:
        whole, step = F.split_part(x, F.lit("/"), F.lit(1)), F.split_part(x, F.lit("/"), F.lit(2))
        number = lambda k: F.split_part(whole, F.lit("-"), F.lit(k)).try_cast("int")
        star, every = x.startswith("*"), F.when(x.contains("/"), step.try_cast("int")).otherwise(1)
        first = F.when(star, low).otherwise(number(1))
        last = F.when(star, high).when(whole.contains("-"), number(2)).when(x.contains("/"), high).otherwise(first)
        ok = x.rlike(r"^(?:\*|\d+(?:-\d+)?)(?:/\d+)?$") & (first >= low) & (first <= last) & (last <= high) & (every > 0)
        join = lambda bits, value: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), value))
        # A null bound makes the sequence and so the set null.
        return F.aggregate(F.when(ok, F.sequence(first, last, every)), F.lit(0).cast("long"), join)

    return F.aggregate(F.transform(F.split(field, ","), item), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(x))


def next_due_at(cron: Column, after: Column) -> Column:
    """The next due minute after a time, as a column of local times; null within 1,464 days of none, or for an expression that cannot be read.

    A successor search on bit sets, no grid of minutes: the lowest bit from the minute on, else from the next hour on, else
    the first minute of the next due day. The due days of a month are one bit set, the pattern of the weekdays turned to the
    month's first day and laid out over it, so at most fifty months are looked at.
    """
    let = lambda value, use: F.transform(F.array(value), use)[0]
    long = lambda n: F.lit(n).cast("long")
    has = lambda bits, at: F.getbit(bits, at) == 1
    lowest = lambda bits: F.bit_count(bits.bitwiseAND(-bits) - 1)
    above = lambda bits, at: bits.bitwiseAND(F.call_function("shiftleft", long(-1), at))
    parts = F.split(F.trim(cron), r"\s+")
    names = ("minutes", "hours", "days", "months", "weekdays")
    sets = [cron_bits(F.get(parts, F.lit(i)), low, high).alias(name) for i, (name, (low, high)) in enumerate(zip(names, CRON_FIELDS, strict=True))]
    local = after.cast("timestamp_ntz")
    minute = F.hour(local) * 60 + F.minute(local) + 1
    begin = F.struct(F.date_add(F.to_date(local), (minute == DAY).cast("int")).alias("day"), (minute % DAY).alias("clock"), *sets)

    def due_days(s: Column, month: Column) -> Column:
        """The due days of a month that begins with ``month``, day k at bit k."""
        first = F.dayofweek(month) - 1
        turned = F.call_function("shiftright", s["weekdays"], first).bitwiseOR(F.call_function("shiftleft", s["weekdays"], 7 - first)).bitwiseAND(long(127))
        weekdays = turned * long(sum(2 << 7 * week for week in range(5)))
        either = (F.bit_count(s["days"]) < 31) & (F.bit_count(s["weekdays"]) < 7)
        both = F.when(either, s["days"].bitwiseOR(weekdays)).otherwise(s["days"].bitwiseAND(weekdays))
        inside = F.call_function("shiftleft", long(2), F.dayofmonth(F.last_day(month))) - 2
        return F.when(has(s["months"], F.month(month)), both.bitwiseAND(inside)).otherwise(long(0))

    def later_day(s: Column) -> Column:
        """The first due day after the one that the search begins with."""
        start = F.trunc(s["day"], "MM")

        def look(found: Column, ahead: Column) -> Column:
            month = F.add_months(start, ahead)
            days = above(due_days(s, month), F.when(ahead == 0, F.dayofmonth(s["day"]) + 1).otherwise(0))
            return F.when(found.isNotNull(), found).otherwise(let(days, lambda bits: F.when(bits != 0, F.date_add(month, (lowest(bits) - 1).cast("int")))))

        return F.aggregate(F.sequence(F.lit(0), F.lit(49)), F.lit(None).cast("date"), look)

    def search(s: Column) -> Column:
        hour, minutes, hours = F.floor(s["clock"] / 60).cast("int"), s["minutes"], s["hours"]
        now, rest = above(minutes, s["clock"] % 60), above(hours, hour + 1)
        clock = F.when(has(hours, hour) & (now != 0), hour * 60 + lowest(now)).when(rest != 0, lowest(rest) * 60 + lowest(minutes))
        today = F.when(has(due_days(s, F.trunc(s["day"], "MM")), F.dayofmonth(s["day"])), clock)
        day = F.when(today.isNotNull(), s["day"]).otherwise(later_day(s))
        return let(F.struct(day.alias("day"), F.coalesce(today, lowest(hours) * 60 + lowest(minutes)).cast("int").alias("clock")), lambda found: stamp(s, found))

    def stamp(s: Column, found: Column) -> Column:
        soon = F.datediff(found["day"], s["day"]) * DAY + found["clock"] - s["clock"] < 4 * 366 * DAY
        return F.when(soon, F.timestamp_add("MINUTE", found["clock"], found["day"].cast("timestamp_ntz")))

    readable = F.size(parts) == len(CRON_FIELDS)
    return F.when(readable, let(begin, lambda s: F.when(functools.reduce(lambda a, b: a & b, [s[n].isNotNull() for n in names]), search(s))))


def schedule_ticks(schedules: DataFrame, first: datetime, last: datetime, key: str = "source_id", cron: str = "cron", zone: str | None = None, most: int = 1_000_000) -> DataFrame:
    """(key, tick): the due minutes of every schedule in [first, last). An expression that cannot be read is due at no minute.

    Expressions become bit sets in columns, each distinct one once, and a row for each hour that is due. The quarter hours asked
    for meet these by the hour of their local time (offsets of time zones are whole quarters), the bit sets of days and
    months keep or drop them, and only then a quarter's due minutes are laid out. Up to ``most`` quarters, 28 years, are broadcast.
    """
    spark = schedules.sparkSession
    distinct = schedules.filter(F.col(cron).isNotNull()).select(F.col(cron).alias("_cron")).distinct()
    parts = F.split(F.trim("_cron"), r"\s+")
    names = ["_minutes", "_hours", "_days", "_months", "_weekdays"]
    bits = [cron_bits(F.get(parts, F.lit(i)), low, high).alias(name) for i, (name, (low, high)) in enumerate(zip(names, CRON_FIELDS, strict=True))]
    read = distinct.filter(F.size(parts) == len(CRON_FIELDS)).select("_cron", *bits).dropna()
    read = read.withColumn("_hour", F.explode(F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.getbit("_hours", h) == 1)))

    start = first - timedelta(minutes=first.minute % 15, seconds=first.second, microseconds=first.microsecond)
    count = max(0, -int(-(last - start).total_seconds() // 900))
    quarters = spark.range(count).select(F.timestamp_add("MINUTE", (F.col("id") * 15).cast("int"), F.lit(start).cast("timestamp_ntz")).alias("_at"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("_at")) if zone else F.col("_at")
    quarters = quarters.select("_at", F.hour(local).alias("_local"), F.minute(local).alias("_from"), F.dayofmonth(local).alias("_day"), F.month(local).alias("_month"), (F.dayofweek(local) - 1).alias("_weekday"))
    met = read.join(F.broadcast(quarters) if count <= most else quarters, F.col("_hour") == F.col("_local"))
    day, weekday = F.getbit("_days", "_day") == 1, F.getbit("_weekdays", "_weekday") == 1
    either = (F.bit_count("_days") < 31) & (F.bit_count("_weekdays") < 7)
    met = met.filter((F.getbit("_months", "_month") == 1) & F.when(either, day | weekday).otherwise(day & weekday))
    minutes = F.filter(F.sequence(F.lit(0), F.lit(14)), lambda m: F.getbit("_minutes", F.col("_from") + m) == 1)
    met = met.select("_cron", "_at", F.explode(minutes).alias("_minute")).select("_cron", F.timestamp_add("MINUTE", F.col("_minute"), F.col("_at")).alias("tick"))
    due = met.filter(F.col("tick").between(F.lit(first).cast("timestamp_ntz"), F.lit(last - timedelta(microseconds=1)).cast("timestamp_ntz")))
    return schedules.join(due, F.col(cron) == F.col("_cron")).select(key, "tick")


def _clock(text: str) -> int | None:
    m = CLOCK.fullmatch(text.strip())
    return int(m[1]) * 60 + int(m[2]) if m else None


def _week_days(spec: str) -> set[int]:
    """Days that a comma list of names and spans names; spans may pass the end of the week, names that are none count for nothing."""
    found: set[int] = set()
    for part in spec.strip().lower().split(","):
        if part.strip() in ("*", "all"):
            return set(range(7))
        ends = [DAY_NUMBER.get(name.strip()) for name in part.split("-")[:2]]
        if None not in ends:
            found |= {day % 7 for day in range(ends[0], ends[0] + (ends[-1] - ends[0]) % 7 + 1)}
    return found


def week_minutes(window: dict) -> list[tuple[int, int]]:
    """A window as half-open intervals of the week's minutes, from Sunday's midnight; empty if it cannot be read."""
    first, last = _clock(window["from"]), _clock(window["to"])
    if first is None or last is None:
        return []
    length = last - first if last >= first else last - first + DAY
    spans = [(day * DAY + first, day * DAY + first + length) for day in sorted(_week_days(window["days"])) if length]
    return [part for a, b in spans for part in ([(a, b)] if b <= WEEK else [(a, WEEK), (0, b - WEEK)])]


def unreadable_windows(windows: Sequence[dict]) -> list[dict]:
    return [w for w in windows if _clock(w["from"]) is None or _clock(w["to"]) is None]


def in_blackout(ts: Column, windows: Sequence[dict], zone: str | None = None) -> Column:
    """Whether a time lies in a window: days, from, to; windows may wrap midnight and the week.

    The clock is that of the session, or, for times in UTC, of ``zone``. A window that cannot be read excludes nothing.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz")) if zone else ts
    at = (F.dayofweek(local) - 1) * DAY + F.hour(local) * 60 + F.minute(local)
    spans = sorted({span for window in windows for span in week_minutes(window)})
    return functools.reduce(lambda found, span: found | ((at >= span[0]) & (at < span[1])), spans, F.lit(False))


def intersect_capability(asked: dict, granted: dict) -> dict:
    """What a source may do: hosts in both, the smaller quota, the larger delay, robots off only if both say so."""
    return {
        "hosts": sorted(set(asked["hosts"]) & set(granted["hosts"])),
        "per_minute": min(asked.get("per_minute", 60), granted.get("per_minute", 60)),
        "delay_ms": max(asked.get("delay_ms", 1000), granted.get("delay_ms", 1000), 100),
        "robots": asked.get("robots", True) or granted.get("robots", True),
        "per_host": max(1, min(asked.get("per_host", 2), granted.get("per_host", 2), 10)),
    }


def intersect_capabilities(asked: Column, granted: Column) -> Column:
    """The same for two struct columns of hosts, per_minute, delay_ms, robots and per_host."""
    smaller, larger = lambda c: F.least(asked[c], granted[c]), lambda c: F.greatest(asked[c], granted[c])
    return F.struct(
        F.sort_array(F.array_intersect(asked["hosts"], granted["hosts"])).alias("hosts"),
        smaller("per_minute").alias("per_minute"),
        F.greatest(larger("delay_ms"), F.lit(100)).alias("delay_ms"),
        (asked["robots"] | granted["robots"]).alias("robots"),
        F.greatest(F.lit(1), F.least(smaller("per_host"), F.lit(10))).alias("per_host"),
    )
