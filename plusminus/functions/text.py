"""Column functions over log lines and page-view lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One combined-log line: host, date and time, request, response, bytes, referer and, if there is one, the user agent.
LOG_PATTERN = r'^\s*(\S+)\s+\S+\s+([^\[]*)\[([^\]]*)\][^"]*"([^"]+)"\s*(\S+)\s+(\S+)[^"]*"([^"]*)"(?:[^"]*"([^"]*)")?'
LOG_TIME = "dd/MMM/yyyy:HH:mm:ss Z"
#: Paths that scanners for weak spots ask for (fixed values).
ATTACK_PREFIXES = ("/w00tw00t", "/phpMyAdmin", "/pma", "/myadmin", "/MyAdmin", "/phpTest", "/cgi-bin/php", "/cgi-bin/php5", "/cgi-bin/php-cgi")


def parse_log(line: Column) -> dict[str, Column]:
    """host, datetime, request, response, bytes, referer, user_agent and parsed (false for a line that is no record).

    A line without a referer is none; without a user agent it is one, with the agent `-`.
    """
    part = lambda k: F.regexp_extract(line, LOG_PATTERN, k)
    parsed = F.coalesce(line.rlike(LOG_PATTERN), F.lit(False))
    names = {"host": 1, "datetime": 3, "request": 4, "response": 5, "bytes": 6, "referer": 7}
    out = {n: F.when(parsed, part(k)) for n, k in names.items()}
    out["user_agent"] = F.when(parsed, F.when(part(8) == "", "-").otherwise(part(8)))
    return out | {"parsed": parsed}


def request_path(request: Column) -> Column:
    """The second word of a request, its path; null if it has no second word."""
    return F.get(F.split(request, " "), 1)


def is_attack(request: Column) -> Column:
    """Whether the path of a request begins with one of ATTACK_PREFIXES."""
    path, found = request_path(request), F.lit(False)
    for prefix in ATTACK_PREFIXES:
        found = found | path.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def without_query(request: Column) -> Column:
    """What stands before the first question mark, if that isn't the first character."""
    return F.when(F.instr(request, "?") > 1, F.substring_index(request, "?", 1)).otherwise(request)


def week_hour(datetime: Column) -> Column:
    """`Sun 11` of a log's date and time, in the session's time zone; null if it is none."""
    return F.date_format(F.try_to_timestamp(datetime, F.lit(LOG_TIME)), "EEE HH")


def byte_count(text: Column) -> Column:
    """Bytes as a long; null for `-` and anything else that is no number."""
    return text.try_cast("long")


def parse_view(line: Column) -> dict[str, Column]:
    """date, hour, project, page, size and parsed, of a line of at least four fields between blanks or tabs."""
    # Trailing empty fields don't count, as they are none of a split that drops them.
    fields = F.split(F.rtrim(F.replace(line, F.lit("\t"), F.lit(" "))), " ")
    parsed = F.coalesce(F.size(fields) >= 4, F.lit(False))
    out = {n: F.when(parsed, F.get(fields, k)) for k, n in enumerate(("date", "hour", "project", "page"))}
    return out | {"size": F.get(fields, 4).try_cast("long"), "parsed": parsed}
