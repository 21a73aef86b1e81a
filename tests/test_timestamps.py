import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from marginalia.operators import timestamps as ts


def us(*parts):
    return int((dt.datetime(*parts) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def conform(value, zone="UTC", locale="en-GB"):
    found = {r.utc_us for r in ts.interpretations(value, zone, locale) if r.conform}
    assert len(found) <= 1
    return found.pop() if found else None


@pytest.mark.parametrize(
    ("value", "zone", "locale", "expected"),
    [
        ("2024-08-15T05:19:00Z", "Europe/Madrid", "en-US", us(2024, 8, 15, 5, 19)), ("20240815T051900Z", None, None, us(2024, 8, 15, 5, 19)), ("Jan. 11th, 2012", "UTC", "en-US", us(2012, 1, 11)),
        ("04/06/2009", "UTC", "en-US", us(2009, 4, 6)), ("04/06/2009", "UTC", "en-GB", us(2009, 6, 4)), ("04/06/2009", "UTC", None, us(2009, 6, 4)), ("2019-185", "UTC", "x", us(2019, 7, 4)),
        ("2022-W02-7", "UTC", "x", us(2022, 1, 16)), ("15-Sep-22", "UTC", "x", us(2022, 9, 15)), ("06/2019", "UTC", "x", us(2019, 6, 1)), ("2017", "UTC", "x", us(2017, 1, 1)), ("agosto de 2019", "UTC", "x", us(2019, 8, 1)),
        ("30 mars 2025", "Europe/Berlin", "fr-FR", us(2025, 3, 29, 23)), ("3. Januar 2025, 05:31:17 Uhr", "UTC", "de-DE", us(2025, 1, 3, 5, 31, 17)), ("12/7/2016 10:54 PM", "UTC", "en-US", us(2016, 12, 7, 22, 54)),
        ("11 décembre 2024 à 18h59", "UTC", "fr-FR", us(2024, 12, 11, 18, 59)), ("Sun Mar  1 04:29:12 2020", "UTC", "x", us(2020, 3, 1, 4, 29, 12)), ("Tue, 04 Apr 2017 02:01:49 +0100", None, "x", us(2017, 4, 4, 1, 1, 49)),
        ("2019-09-23 07:08 America/New_York", "UTC", "x", us(2019, 9, 23, 11, 8)), ("16 January 2022 06:37 CET", "Europe/Berlin", "x", us(2022, 1, 16, 5, 37)), ("1432036860", None, "x", 1432036860 * 10**6),
        ("1603886444218", "x", "x", 1603886444218 * 1000), (" 2014-12 ", "UTC", "x", us(2014, 12, 1)), ("2021-06-03T02:35:20,526+00:00", "UTC", "x", us(2021, 6, 3, 2, 35, 20) + 526_000),
        # twice: the first occurrence; skipped: the offset before the change
        ("2020-11-01 01:30", "America/New_York", "x", us(2020, 11, 1, 5, 30)), ("2021-03-14 02:30", "America/New_York", "x", us(2021, 3, 14, 7, 30)),
        ("12:00 AM", "UTC", "x", None), ("1/2/2020 0:30 AM", "UTC", "en-US", None), ("1/2/2020 12:30 AM", "UTC", "en-US", us(2020, 1, 2, 0, 30)),
        ("2021-02-30", "UTC", "x", None), ("31/11/2019", "UTC", "x", None), ("2018-06-07T25:61:00Z", "UTC", "x", None), ("circa 2015", "UTC", "x", None), ("Q3 2019", "UTC", "x", None), ("spring 2020", "UTC", "x", None),
        ("", "UTC", "x", None), (None, "UTC", "x", None), ("2021-02-03", None, "x", None), ("2021-02-03", "No/Zone", "x", None),
    ],
)
def test_readings(value, zone, locale, expected):
    assert conform(value, zone, locale) == expected


def test_local_times_agree_with_the_zone_data():
    rng = random.Random(1)
    for _ in range(300):
        t = dt.datetime(2010, 1, 1) + dt.timedelta(minutes=rng.randint(0, 7_000_000))
        name = rng.choice(["Europe/Berlin", "America/Chicago", "Australia/Sydney", "Asia/Kathmandu"])
        expected = t.replace(tzinfo=ZoneInfo(name), fold=0).astimezone(dt.timezone.utc).replace(tzinfo=None)
        assert conform(t.strftime("%Y-%m-%d %H:%M"), name) == us(*expected.timetuple()[:6])


def brute(readings, against, switch, backward):
    import itertools

    def cost(path):
        total = sum(0 if r.conform else against for r in path)
        return total + sum(switch * (a.form != b.form) + backward * (a.utc_us > b.utc_us) for a, b in itertools.pairwise(path))

    return min(map(cost, itertools.product(*readings)))


def test_viterbi_finds_the_least_cost():
    rng = random.Random(2)
    for _ in range(200):
        rows = [[ts.Reading(rng.randint(0, 5), rng.choice("ab"), rng.random() < 0.5) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
        weights = rng.choice([(100, 1, 1), (1, 2, 3), (0, 1, 0.5)])
        path = ts.choose(rows, *weights)
        assert brute([[r] for r in path], *weights) == brute(rows, *weights)
    mixed = [[], [ts.Reading(1, "a", True)], []]
    assert ts.choose(mixed) == [None, mixed[1][0], None] and ts.choose([]) == []


def test_order_decides_where_conventions_do_not():
    days = ["03/01/2020", "04/01/2020", "25/01/2020"]
    read = [ts.interpretations(d, "UTC", "en-US") for d in days]  # the last can only be day first
    loose = ts.choose(read, against=0.0)
    assert [r.form for r in loose] == ["day/month"] * 3
    assert [r.form for r in ts.choose(read)] == ["month/day", "month/day", "day/month"]


def test_frames(spark):
    rows = [("e1", "r", 0, "2020-01-01", "UTC", "en-GB"), ("e1", "r", 0, "2020-01-01", "UTC", "en-GB"), ("e2", "r", 1, None, "UTC", "en-GB"), ("e3", None, None, "2021", "UTC", "en-GB"), (None, "r", 2, "2021", "UTC", "en-GB")]
    df = spark.createDataFrame(rows, "event_id string, report_id string, pos int, event_date string, zone_name string, locale string").withColumnRenamed("report_id", "source")
    found = ts.normalise_events(df, "timeline", "event_id", "event_date", "source", "pos")
    assert sorted((r.record_key, r.pos, r.utc_us) for r in found.collect()) == sorted([("e1", 0, us(2020, 1, 1)), ("e2", 0, None), ("e3", 0, us(2021, 1, 1))], key=str)
    assert ts.normalise_events(df.limit(0), "timeline", "event_id", "event_date", "source", "pos").count() == 0
    lists = spark.createDataFrame([("c", ["2020", None, "x"], "UTC", "en-GB"), ("d", None, "UTC", "en-GB"), ("e", [], None, None)], "chunk_id string, dates array<string>, zone_name string, locale string")
    assert sorted((r.record_key, r.pos, r.utc_us) for r in ts.normalise_lists(lists, "knowledge", "chunk_id", "dates").collect()) == [("c", 0, us(2020, 1, 1)), ("c", 1, None), ("c", 2, None)]


def test_blocks_decide_as_the_whole_source(spark):
    rng = random.Random(4)
    values = [rng.choice(["2020-05-06", "03/04/2020", "15-Sep-20", "06-Jul-21"]) for _ in range(300)]
    df = spark.createDataFrame([(f"e{i}", "r", i, v, "UTC", "en-US") for i, v in enumerate(values)], "k string, s string, pos int, v string, zone_name string, locale string")
    whole = ts.choose([ts.interpretations(v, "UTC", "en-US") for v in values])
    found = {r.record_key: r.utc_us for r in ts.normalise_events(df, "t", "k", "v", "s", "pos", block=16, halo=8).collect()}
    assert [found[f"e{i}"] for i in range(300)] == [r.utc_us for r in whole]
