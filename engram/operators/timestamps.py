"""Mixed timestamp formats and time zones -> one UTC instant.

Every text is read under each format whose grammar it meets and that states an existing instant; these are its
valid parses. Per source (table and agent) the shares of the formats are estimated by expectation-maximisation
over the values' sets of valid parses, and each value takes the reading of the highest posterior. What is known
of a source enters as the prior: the order of dates in its locale leaves the other orders no mass, without a
locale all orders have the same. A value whose best reading stays under ``min_posterior`` is marked
``ambiguous`` instead of guessed.

Values are parsed once; what the estimate sees is their number by source and set of valid parses.

Defined results: null, empty and unreadable texts give status ``unreadable`` and a null instant, as do texts whose
only readings have no prior; a local time that occurs twice is the first of the two; one that never occurs is read
with the offset in force before the change; a local time of an agent without a known zone is ``unreadable``;
repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.session import BROADCAST_ROWS, bounded_join, cut, stage

# Month names and abbreviations of the six languages, folded to lower case with dotted i.
MONTHS = {
    1: "january jan januar jän janvier janv enero ene janeiro ocak oca",
    2: "february feb februar février fevrier févr fevr febrero fevereiro fev şubat subat şub",
    3: "march mar märz maerz mär mars marzo março marco mart",
    4: "april apr avril avr abril abr nisan nis",
    5: "may mai mayo maio mayis",
    6: "june jun juni juin junio junho haziran haz",
    7: "july jul juli juillet juil julio julho temmuz tem",
    8: "august aug août aout agosto ago ağustos agustos ağu",
    9: "september sep sept septembre septiembre setembro set eylül eylul eyl",
    10: "october oct oktober okt octobre octubre outubro out ekim eki",
    11: "november nov novembre noviembre novembro kasim kas",
    12: "december dec dezember dez décembre decembre déc diciembre dic dezembro aralik ara",
}
# Regions that write the month first; all others write the day first, these few the year.
MONTH_FIRST = ("us", "ph", "bz", "fm", "pw")
YEAR_FIRST = ("jp", "cn", "kr", "tw", "hu", "lt", "mn")
UNIVERSAL = ("z", "utc", "gmt", "ut", "zulu")

CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"
ORDERS = ("dmy", "mdy", "ymd")
#: The formats of the mixture; a set of them is a number with a bit for each.
FORMATS = ("epoch_s", "epoch_ms", "epoch_us", "epoch_ns", "basic", "iso", "day_month", "month_day", *ORDERS)
ZONE = r"(?:(?:utc|gmt|ut)?\s?([+\-\u2212]\d{1,2}(?::?\d{2})?)|([a-z]{1,5}))?\s*(?:\[([a-z0-9_+\-]+(?:/[a-z0-9_+\-]+)*)\])?"
TIMED = r"\A(.*?)(?:[t,]\s*|\s+|,\s*(?:at|um|à|a las|às|saat)\s+|\s+(?:at|um|à|a las|às|saat)\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?)?\s*" + ZONE + r"\z"
BASIC = r"\A(\d{4})-?(\d{2})-?(\d{2})t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*" + ZONE + r"\z"
WEEKDAY = r"\A\p{L}{2,10}\.?,\s*"


def month_map() -> Column:
    """Folded month name -> number."""
    pairs = [x for n, names in MONTHS.items() for name in dict.fromkeys(names.split()) for x in (F.lit(name), F.lit(n))]
    return F.create_map(*pairs)


def locale_order(locale: Column) -> Column:
    """Order of numeric dates in a locale such as ``en-US``; null for an unknown one."""
    region = F.lower(F.regexp_extract(locale, r"[-_]([A-Za-z]{2})\z", 1))
    return F.when(region.isin(*MONTH_FIRST), "mdy").when(region.isin(*YEAR_FIRST), "ymd").when(region != "", "dmy")


def zone_table(agents: DataFrame, years: tuple[int, int] = (1970, 2037)) -> DataFrame:
    """(home_zone, abbrs): abbreviation -> offset seconds of each zone in use.

    Of an abbreviation that meant several offsets over time the latest meaning holds; names no zone database knows are
    left out. Zones are looked up where their rows are, so no list of them comes to the driver.
    """

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for zone in pdf["home_zone"]:
                try:
                    tz = ZoneInfo(zone)
                except Exception:
                    continue
                abbrs: dict[str, int] = {}
                for year in range(*years):
                    for month in range(1, 13):
                        at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(tz)
                        abbrs[at.tzname().lower()] = int(at.utcoffset().total_seconds())
                rows.append((zone, {k: v for k, v in abbrs.items() if k[0].isalpha()}))
            yield pd.DataFrame(rows, columns=["home_zone", "abbrs"])

    return agents.select("home_zone").where("home_zone is not null").distinct().mapInPandas(look_up, "home_zone string, abbrs map<string,int>")


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date, null where it doesn't exist."""
    fits = y.between(1, 9999) & m.between(1, 12) & (d >= 1)
    first = F.make_date(F.when(fits, y), F.when(fits, m), F.lit(1))
    return F.when(fits & (d <= F.dayofmonth(F.last_day(first))), F.unix_date(first) + d - 1)


def _groups(c: str, pattern: str, n: int) -> Column:
    """All groups of one match as an array (element 0 is "y" on a match), from a single evaluation."""
    marks = "y" + "".join(f"\u0001${i}" for i in range(1, n + 1))
    return F.when(F.col(c).rlike(pattern), F.split(F.regexp_replace(c, pattern, marks), "\u0001"))


def parse(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the parts of a time text: _kind (the one format that needs no order, if it is one), _epoch_ms, or _day or
    _dmy, _mdy, _ymd (days), _clock (ms), _off, _abbr, _region."""
    text = F.regexp_replace(F.regexp_replace(F.col(ts), r"(?U)^\s+|\s+$", ""), r"(?iU)^D\d+:\s*", "")
    text = F.regexp_replace(F.translate(F.lower(F.translate(text, "İ：／\u0001", "i:/ ")), "ı", "i"), r"(?U)\s+", " ")
    df = stage(df, _s=text)
    df = stage(df, _t=_groups("_s", TIMED, 9), _b=_groups("_s", BASIC, 10))
    t, b = F.col("_t"), F.col("_b")
    basic = b.isNotNull()
    either = lambda i, j: F.when(basic, b[j]).otherwise(t[i])
    df = stage(
        df, _date=F.regexp_replace(t[1], WEEKDAY, ""), _basic=F.when(basic, _days(_int(b[1]), _int(b[2]), _int(b[3]))),
        _h=_int(either(2, 4)), _mi=_int(either(3, 5)), _se=F.coalesce(_int(either(4, 6)), F.lit(0)),
        _ms=F.substring(F.rpad(F.coalesce(either(5, 7), F.lit("")), 3, "0"), 1, 3).cast("int"),
        _half=F.when(basic, "").otherwise(F.substring(t[6], 1, 1)), _off=either(7, 8), _abbr=either(8, 9), _region=either(9, 10))
    iso = r"\A(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\z"
    dmon = r"\A(\d{1,2})(?:\.|st|nd|rd|th|er|º)?[ \-](?:de |of )?(\p{L}{3,10})\.?[ \-,](?:de |del |of )?(\d{4})\z"
    mond = r"\A(\p{L}{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})\z"
    num = r"\A(\d{1,2})([/.\-])(\d{1,2})\2(\d{4}|\d{2})\z"
    two = r"\A(\d{2})([/.\-])(\d{1,2})\2(\d{1,2})\z"
    df = stage(df, _i=_groups("_date", iso, 4), _dm=_groups("_date", dmon, 3), _md=_groups("_date", mond, 3), _n=_groups("_date", num, 4), _w=_groups("_date", two, 4))
    i, dm, md, n, w, months = (*map(F.col, ("_i", "_dm", "_md", "_n", "_w")), month_map())
    century = lambda y: y + F.when(y < 70, 2000).otherwise(1900)
    year = F.when(F.length(n[4]) == 2, century(_int(n[4]))).otherwise(_int(n[4]))
    df = stage(df, _y=year, _n1=_int(n[1]), _n2=_int(n[3]), _yy=century(_int(w[1])), _w2=_int(w[3]), _w3=_int(w[4]),
               _hour=F.when(F.col("_half").isin("a", "p"), F.when(F.col("_h").between(1, 12), F.when(F.col("_half") == "p", 12).otherwise(0) + F.col("_h") % 12)).otherwise(F.col("_h")))
    whole, part, long = (F.regexp_extract("_s", p, g) for p, g in ((r"\A(\d{10})(?:[.,](\d+))?\z", 1), (r"\A(\d{10})(?:[.,](\d+))?\z", 2), (r"\A(\d{13}|\d{16}|\d{19})\z", 1)))
    epoch_ms = F.when(long != "", F.substring(long, 1, 13).cast("long")).when(
        whole != "", whole.cast("long") * 1000 + F.substring(F.rpad(part, 3, "0"), 1, 3).cast("long"))
    named = F.when(dm.isNotNull(), _days(_int(dm[3]), F.element_at(months, dm[2]), _int(dm[1]))).when(md.isNotNull(), _days(_int(md[3]), F.element_at(months, md[1]), _int(md[2])))
    day = F.when(F.col("_b").isNotNull(), F.col("_basic")).when(i.isNotNull(), _days(_int(i[1]), _int(i[3]), _int(i[4]))).otherwise(named)
    hour, minute, second = F.col("_hour"), F.col("_mi"), F.col("_se")
    clock = F.when((hour < 24) & (minute < 60) & (second < 60), (hour * 3600 + minute * 60 + second).cast("long") * 1000 + F.col("_ms"))
    kind = F.when(long != "", F.element_at(F.create_map(*[F.lit(x) for x in (13, "epoch_ms", 16, "epoch_us", 19, "epoch_ns")]), F.length(long))).when(whole != "", "epoch_s")
    kind = kind.when(F.col("_b").isNotNull(), "basic").when(i.isNotNull(), "iso").when(dm.isNotNull(), "day_month").when(md.isNotNull(), "month_day")
    df = stage(df, _kind=kind, _epoch_ms=epoch_ms, _day=day, _clock=clock, _dmy=_days(F.col("_y"), F.col("_n2"), F.col("_n1")),
               _mdy=_days(F.col("_y"), F.col("_n1"), F.col("_n2")), _ymd=_days(F.col("_yy"), F.col("_w2"), F.col("_w3")))
    return df.drop("_s", "_t", "_b", "_date", "_basic", "_h", "_mi", "_se", "_ms", "_half", "_i", "_dm", "_md", "_n", "_w", "_y", "_n1", "_n2", "_yy", "_w2", "_w3", "_hour")


def zone_rule() -> dict[str, Column]:
    """How a text's local time becomes UTC: _fixed (offset in seconds that it states) or _local (the home zone holds)."""
    zone, region, given = F.col("_zone"), F.coalesce("_region", F.lit("")), lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    off = F.translate("_off", "\u2212", "-")
    hh = _int(F.regexp_extract(off, r"\A[+\-](\d{1,2})", 1))
    mm = F.when(F.length(off) >= 5, _int(F.regexp_extract(off, r"(\d{2})\z", 1))).otherwise(0)
    seconds = F.when((hh <= 18) & (mm < 60), F.when(off.startswith("-"), -1).otherwise(1) * (hh * 3600 + mm * 60))
    abbr = F.when(F.col("_abbr").isin(*UNIVERSAL), F.lit(0)).otherwise(F.element_at("_abbrs", F.col("_abbr")))
    local = ~given("_off") & ~given("_abbr") & ((region == "") | (F.lower(zone) == region))
    return {"_fixed": F.when(given("_off"), seconds).when(given("_abbr"), abbr), "_local": local}


def to_instant(day: Column) -> Column:
    """Epoch ms of a day under the text's ``zone_rule``."""
    local = day.cast("long") * 86_400_000 + F.col("_clock")
    home = F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), F.col("_zone")))
    return F.when(F.col("_fixed").isNotNull(), local - F.col("_fixed").cast("long") * 1000).when(F.col("_local"), home)


def em_choices(stats: DataFrame, prior: float = 1.0, rounds: int = 50) -> DataFrame:
    """(source, parses, choice, posterior) by expectation-maximisation over each source's mixture of formats.

    ``stats`` has (source, known, parses, n): the order its locale states (or null), a set of valid parses and how many
    values have it. A source has at most a few dozen sets however many values, so its group is bounded. Orders other
    than a known one have prior zero and stay there; a set without any format of positive prior has no choice.
    """
    bits, width = {f: 1 << i for i, f in enumerate(FORMATS)}, len(FORMATS)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = next((k for k in pdf["known"] if isinstance(k, str)), None)
        base = np.array([0.0 if known and f in ORDERS and f != known else prior / width for f in FORMATS])
        valid = np.array([[bool(m & b) for b in bits.values()] for m in pdf["parses"]], float) * (base > 0)
        n, w = pdf["n"].to_numpy(float), base / base.sum()
        for _ in range(rounds):
            like = valid * w
            post = like / like.sum(axis=1, keepdims=True).clip(1e-300)
            w = (post * n[:, None]).sum(axis=0) + base
            w = w / w.sum()
        like = valid * w
        post = like / like.sum(axis=1, keepdims=True).clip(1e-300)
        best = post.argmax(axis=1)
        some = valid.any(axis=1)
        return pd.DataFrame({"source": key[0], "parses": pdf["parses"].to_numpy(), "choice": [FORMATS[b] if s else None for b, s in zip(best, some)], "posterior": [float(p[b]) if s else None for p, b, s in zip(post, best, some)]})

    # Rows of one set may come as several: the fit needs each once.
    sets = stats.groupBy("source", "parses").agg(F.max("known").alias("known"), F.sum("n").alias("n"))
    return sets.groupBy("source").applyInPandas(fit, "source string, parses int, choice string, posterior double")


def normalise(df: DataFrame, agents: DataFrame, min_posterior: float = 0.9, ts: str = "ts") -> DataFrame:
    """Adds epoch_ms, format, posterior, status to ``df`` (source, row_id, agent_id, ts, ...).

    status: ``exact`` (already canonical), ``resolved``, ``ambiguous``, ``unreadable``. Columns of other
    names pass through; an agent met twice counts once.
    """
    agents = agents.where("agent_id is not null").groupBy("agent_id").agg(F.max(F.struct("home_zone", "locale")).alias("a")).select("agent_id", "a.*")
    agents = bounded_join(agents, zone_table(agents), ["home_zone"])
    agents = agents.select("agent_id", F.when(F.col("abbrs").isNotNull(), F.col("home_zone")).alias("_zone"), locale_order(F.col("locale")).alias("_order"), F.col("abbrs").alias("_abbrs"))
    parsed = bounded_join(parse(df, ts), agents, ["agent_id"], limit=BROADCAST_ROWS // 4)
    parsed = stage(parsed, **zone_rule())
    parsed = stage(parsed, _at=F.coalesce(F.col("_epoch_ms"), to_instant(F.col("_day"))), **{f"_at_{k}": to_instant(F.when(F.col("_kind").isNull(), F.col(f"_{k}"))) for k in ORDERS})
    bit = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FORMATS) for x in (f, 1 << i)]), F.col("_kind"))
    own = sum((F.when(F.col(f"_at_{k}").isNotNull(), 1 << FORMATS.index(k)).otherwise(0) for k in ORDERS), F.when(F.col("_at").isNotNull(), bit).otherwise(0))
    ats = ["_at", *[f"_at_{k}" for k in ORDERS]]
    parsed = cut(parsed.select(*df.columns, F.concat_ws("/", "source", "agent_id").alias("_src"), F.col("_order").alias("_known"), own.cast("int").alias("_parses"), *ats))
    stats = parsed.where("_parses > 0").groupBy(F.col("_src").alias("source"), F.col("_known").alias("known"), F.col("_parses").alias("parses")).agg(F.count("*").alias("n"))
    choices = cut(em_choices(stats)).select(F.col("source").alias("_src"), F.col("parses").alias("_parses"), F.col("choice").alias("_choice"), F.col("posterior").alias("_post"))
    read = bounded_join(parsed, choices, ["_src", "_parses"])
    at = F.when(F.col("_choice").isNotNull(), F.col("_at"))
    for k in ORDERS:
        at = F.when(F.col("_choice") == k, F.col(f"_at_{k}")).otherwise(at)
    read = stage(read, _instant=at)
    exact = F.coalesce(F.col(ts).rlike(CANONICAL), F.lit(False))
    sure = F.col("_post") >= min_posterior
    return read.select(
        *df.columns, F.when(sure, F.col("_instant")).alias("epoch_ms"), F.when(exact, "canonical").otherwise(F.col("_choice")).alias("format"), F.coalesce("_post", F.lit(1.0)).alias("posterior"),
        F.when(F.col("_instant").isNull(), "unreadable").when(~sure, "ambiguous").when(exact, "exact").otherwise("resolved").alias("status"))
