"""Log parsing, search, metrics and security bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions.timing import bucket, epoch_us, last
from aeroband.operators import ordered

C = F.col

# Line shapes.
TEXT_LINE = r"^\[?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?:,(\d{3}))?\]? \[([A-Z]+) *\] \[([^\]]*)\] (.*)$"
ACCESS_LINE = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+) ([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
TIMESTAMP_PREFIX = r"^\[?\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
JSON_SCHEMA = ("timestamp timestamp, level string, logger string, module string, function string, line int, message string, "
               "request_id string, user_id string")


def parse_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """Time, level, logger and message of plain lines; null fields when the shape differs."""
    def part(k):
        return F.regexp_extract(line, TEXT_LINE, k)

    stamp = F.to_timestamp(F.nullif(part(1), F.lit("")))
    return lines.select("*", F.nullif(part(3), F.lit("")).alias("level"), F.nullif(part(4), F.lit("")).alias("logger"),
                        F.nullif(part(5), F.lit("")).alias("message"), stamp.cast("timestamp_ntz").alias("ts"))


def parse_json(lines: DataFrame, line: str = "line") -> DataFrame:
    """Declared fields plus every other key as text in ``extra``."""
    known = [f.split()[0] for f in JSON_SCHEMA.split(", ")]
    whole = F.from_json(C(line), "map<string,string>")
    return lines.select("*", F.from_json(C(line), JSON_SCHEMA).alias("_j"),
                        F.map_filter(whole, lambda k, v: ~k.isin(*known)).alias("extra")).select("*", "_j.*").drop("_j")


def parse_access(lines: DataFrame, line: str = "line") -> DataFrame:
    names = ["client", "user", "time_text", "method", "path", "protocol", "status", "bytes", "referer", "agent"]
    parsed = lines.select("*", *[F.regexp_extract(line, ACCESS_LINE, i + 1).alias(n) for i, n in enumerate(names)])
    return parsed.withColumns({
        "status": C("status").try_cast("int"), "bytes": C("bytes").try_cast("long"),
        "ts": F.try_to_timestamp(C("time_text"), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))})


def search(parsed: DataFrame, as_of, level=None, term: str | None = None, hours: int | None = None, line: str = "line") -> DataFrame:
    out = parsed
    if hours is not None:
        out = out.filter(last("ts", as_of, hours, "HOUR"))
    if level is not None:
        out = out.filter(C("level") == level)
    if term:
        out = out.filter(F.lower(line).contains(term.lower()))
    return out


def error_rate(parsed: DataFrame) -> DataFrame:
    """Total, mean per active hour and the fullest hour of error lines."""
    hours = parsed.filter(C("level").isin("ERROR", "CRITICAL")).groupBy(bucket("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.agg(F.sum("n").alias("total"), F.avg("n").alias("mean_per_hour"),
                     F.max_by("hour", F.struct(C("n"), -epoch_us("hour"))).alias("peak_hour"), F.max("n").alias("peak_count"))


def error_kinds(parsed: DataFrame) -> DataFrame:
    return parsed.filter(C("level") == "ERROR").groupBy("logger").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "logger")


def latency_values(lines: DataFrame, line: str = "line") -> DataFrame:
    value = F.regexp_extract(line, r"latency[=:]\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return lines.filter(value != "").select("*", value.cast("double").alias("latency"))


# Merged log categories.
CATEGORIES = ("system", "api", "hardware", "security", "performance")


def category_of(path: Column) -> Column:
    return F.regexp_extract(path, "/(" + "|".join(CATEGORIES) + ")/[^/]+$", 1)


def level_metrics(parsed: DataFrame, group: str) -> DataFrame:
    return parsed.groupBy(group).agg(
        F.count("*").alias("lines"), F.count_if(C("level") == "ERROR").alias("errors"), F.count_if(C("level") == "WARNING").alias("warnings"),
        F.sum(F.octet_length("line") + 1).alias("bytes"))


def high_error_rate(parsed: DataFrame, per_second: float = 10.0, window: str = "5 minutes", seconds: int = 300) -> DataFrame:
    return (parsed.filter(C("level") == "ERROR").groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
            .filter(C("n") / seconds > per_second).select(C("w.start").alias("start"), "n"))


def fast_growth(sizes: DataFrame, key: str, limit_bytes: int = 100 * 1024 * 1024, tie: str = "line_no") -> DataFrame:
    """Hours in which a file grew by more than the limit."""
    at = F.struct("ts", tie)
    return (sizes.groupBy(key, bucket("hour", "ts").alias("hour"))
            .agg((F.max_by("size_bytes", at) - F.min_by("size_bytes", at)).alias("growth")).filter(C("growth") > limit_bytes))


def silences(parsed: DataFrame, seconds: float = 300, tie: str = "line_no", slice_seconds: int = 3600) -> DataFrame:
    """Gaps longer than the limit between consecutive lines of the whole log."""
    nxt = ordered.with_previous(parsed.select("ts", tie), [], ["ts", tie], {"_next_us": epoch_us("ts")},
                                ordered.time_slice("ts", slice_seconds), following=True)
    gap = (C("_next_us") - epoch_us("ts")) / 1e6
    return nxt.select("ts", tie, gap.alias("gap_s")).filter(C("gap_s") > seconds)


def split_good_bad(lines: DataFrame, line: str = "line"):
    good = C(line).rlike(TIMESTAMP_PREFIX)
    return lines.filter(good), lines.filter(~good)


# Noise to leave out.
NOISY_LOGGERS = ("urllib3", "requests", "asyncio", "matplotlib", "PIL")
NOISY_MESSAGES = ("Heartbeat", "Ping", "Keepalive", "Health check")


def without_noise(parsed: DataFrame, loggers=NOISY_LOGGERS, messages=NOISY_MESSAGES, levels: dict | None = None) -> DataFrame:
    """Drop noisy loggers and messages, and for named loggers the listed levels."""
    drop = C("logger").rlike("^(" + "|".join(loggers) + r")(\.|$)") | C("message").rlike("|".join(messages))
    for name, quiet in (levels or {}).items():
        drop = drop | ((C("logger") == name) & C("level").isin(*quiet))
    return parsed.filter(~F.coalesce(drop, F.lit(False)))


def systematic_sample(df: DataFrame, rate: float, ts: str, tie: str, slice_seconds: int = 3600) -> DataFrame:
    """Every ``floor(1/rate)``-th row in time order over the whole table."""
    if rate >= 1:
        return df
    numbered = ordered.row_numbers(df, [], [ts, tie], ordered.time_slice(ts, slice_seconds), "_n")
    return numbered.filter(C("_n") % int(1 / rate) == 0).drop("_n")


# Key fragments whose values are hidden.
SENSITIVE = ("password", "token", "secret", "api_key", "auth", "credential")


def redact(map_column, fragments=SENSITIVE) -> Column:
    m = C(map_column) if isinstance(map_column, str) else map_column
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("|".join(fragments)), F.lit("[REDACTED]")).otherwise(v))


# Days kept per log class.
LOG_RETENTION = {"system": 30, "api": 90, "error": 180, "debug": 7, "security": 365, "performance": 30}


def bursts(events: DataFrame, keys: list[str], threshold: int, window: str = "1 minute") -> DataFrame:
    """Windows of a key with at least ``threshold`` events."""
    return (events.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
            .filter(C("n") >= threshold).select(*keys, C("w.start").alias("start"), "n"))


def lockouts(failures: DataFrame, key: str, attempts: int = 5, minutes: int = 15) -> DataFrame:
    """Failures that complete ``attempts`` within the trailing minutes."""
    counted = ordered.trailing(failures, [key], "ts", minutes * 60, {"attempts": F.count("*")}, open_start=True)
    return counted.filter(C("attempts") >= attempts)


# Attack classes by pattern.
ATTACK_PATTERNS = {
    "sql_injection": r"(?i)(union\s+select|or\s+1=1|drop\s+table)",
    "xss": r"(?i)(<script|onerror=|javascript:)",
    "path_traversal": r"(\.\./|\.\.\\)",
    "command_injection": r"(;|\|\||&&)\s*(cat|ls|rm|wget|curl)\b",
}


def attack_class(c) -> Column:
    c = C(c) if isinstance(c, str) else c
    out = None
    for name, pattern in ATTACK_PATTERNS.items():
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out
