"""Registered queries without SQL read whole tables: held against plain loops over the tables."""

import pandas as pd
import pytest

from lumiquarry.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def photos():
    e = pd.read_parquet(f"{SF}/events.parquet")
    vectors = set(pd.read_parquet(f"{SF}/embeddings.parquet", columns=["vec_id"])["vec_id"])
    e = e[(e["event_id"] % 500).isin(vectors)]
    at = (e["ts"] - pd.Timestamp("1970-01-01")) / pd.Timedelta(seconds=1)
    return pd.DataFrame({"id": e["event_id"], "day": e["ts"].dt.strftime("%Y-%m-%d"), "at": at, "value": e["value"]})


def strongest(rows, story):
    return {name: set(own.sort_values(["value", "id"], ascending=[False, True])["id"][:300]) for name, own in rows.groupby(story)}


def picks(spark, name):
    out = {}
    for r in registry.queries()[name](spark, SF).collect():
        out.setdefault(r["story"], set()).add(r["photo_id"])
    return out


def test_day_stories_are_of_all_photos(spark, photos):
    want = strongest(photos[photos["value"] >= 3], "day")
    got = picks(spark, "day_stories")
    assert set(got) == {day for day, ids in want.items() if len(ids) >= 3}
    assert all(ids <= want[day] for day, ids in got.items())
    assert any(i % 10 for ids in got.values() for i in ids)


def test_place_stories_are_of_all_visits(spark, photos):
    orders = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey", "o_orderpriority"])
    place_of = dict(zip(orders["o_orderkey"], orders["o_orderpriority"], strict=True))

    def place(at):
        late = int((at - 1_704_067_200) // 600)
        for k in range(late - 3, late + 1):  # a visit takes 900 to 1,260 seconds
            if k in place_of and k * 600 <= at - 1_704_067_200 <= k * 600 + 900 + k % 7 * 60:
                return f"place:{place_of[k]}"

    want = strongest(photos.assign(place=photos["at"].map(place)).dropna(subset=["place"]), "place")
    got = picks(spark, "place_stories")
    assert set(got) == {name for name, ids in want.items() if len(ids) >= 30}
    assert all(ids <= want[name] for name, ids in got.items())
    end = photos[photos["at"] > 1_704_067_200 + 4001 * 600 + 1260]["id"]
    assert set().union(*got.values()) & set(end)
