"""Places: areas of addresses, polygons of neighbourhoods, and what is known of a restaurant's locations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import CONFIDENCE, MIN_DISHES, address_key, address_usable, area_code, in_city
from larder.sources.scratch import stored

#: Side of a grid cell in degrees; points and polygons meet by cell.
CELL = 0.02


def _cell(c: Column) -> Column:
    return F.floor(c / CELL).cast("bigint")


def _edges(ring: Column) -> Column:
    """A ring's edges, from each point to the one before it, the first's to the last."""
    n = F.size(ring)
    edge = lambda a, b: F.struct(a["longitude"].alias("x"), a["latitude"].alias("y"), b["longitude"].alias("to_x"), b["latitude"].alias("to_y"))
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: edge(F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))))
    return F.when(n > 0, each)


def laid_areas(areas: DataFrame) -> DataFrame:
    """(city, area_id, a, edges, first, last): of each active area and row of the grid that its outline is in, the edges that are
    in that row, and the columns between which they lie. An edge stands once in each row it reaches, so all of it grows with the
    outline, whatever the cells inside."""
    ring = F.explode("rings").alias("ring")
    edge = areas.filter("active").select(F.lower("city").alias("city"), "area_id", ring).select("city", "area_id", F.explode(_edges(F.col("ring"))).alias("e"))
    edge = edge.filter("e.y <> e.to_y")  # a level one meets no level ray
    rows = F.sequence(_cell(F.least("e.y", "e.to_y")), _cell(F.greatest("e.y", "e.to_y")))
    placed = edge.select("city", "area_id", "e", F.explode(rows).alias("a"))
    first, last = F.min(_cell(F.least("e.x", "e.to_x"))), F.max(_cell(F.greatest("e.x", "e.to_x")))
    return placed.groupBy("city", "area_id", "a").agg(F.collect_list("e").alias("edges"), first.alias("first"), last.alias("last"))


def _crossings(edges: Column, latitude: Column, longitude: Column) -> Column:
    """How many edges a ray from the point to the east meets."""

    def meets(e: Column) -> Column:
        straddles = (e["y"] > latitude) != (e["to_y"] > latitude)
        x = F.try_divide((e["to_x"] - e["x"]) * (latitude - e["y"]), e["to_y"] - e["y"]) + e["x"]
        return F.when(straddles & (longitude < x), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + meets(e))


def assign_neighbourhoods(points: DataFrame, areas: DataFrame) -> DataFrame:
    """points: id, city, latitude, longitude; areas: area_id, city, rings, active. Each point's first active area, or null.

    A ray to the east only meets edges of the point's own row of the grid. So points meet areas by cell, an equi-join with rows
    that hold nothing but keys, and then the edges of that area and row; no ring is copied into the cells it covers. Holes are
    rings like any other: an odd number of edges is inside.
    """
    laid = laid_areas(areas)
    keys = laid.select("city", "area_id", "a", F.explode(F.sequence("first", "last")).alias("b"))
    at = points.select("id", F.lower("city").alias("city"), "latitude", "longitude", _cell(F.col("latitude")).alias("a"), _cell(F.col("longitude")).alias("b"))
    near = at.join(keys, ["city", "a", "b"]).drop("b")
    hits = near.join(laid.select("city", "area_id", "a", "edges"), ["city", "area_id", "a"]).filter(_crossings(F.col("edges"), F.col("latitude"), F.col("longitude")) % 2 == 1)
    return points.select("id").join(hits.groupBy("id").agg(F.min("area_id").alias("area_id")), "id", "left")


def assign_areas(rows: DataFrame, city: str = "Dublin") -> DataFrame:
    """Rows of the city with an address and no area get the postal area that the address tells."""
    open_ = in_city(F.col("address"), F.lit(city)) & (F.coalesce("address", F.lit("")) != "") & F.col("area").isNull()
    return rows.withColumn("area", F.when(F.coalesce(open_, F.lit(False)), area_code(F.col("address"))).otherwise(F.col("area")))


def _rank(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), c)


def _ends(key: Column) -> Column:
    """The beginnings and ends of a key at its words' edges, without the whole key."""
    words = F.split(key, " ")
    n = F.size(words)
    return F.array_distinct(F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array(F.array_join(F.slice(words, 1, i), " "), F.array_join(F.slice(words, n - i + 1, i), " "))))))


def _equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b of one restaurant with equal keys, or one key beginning or ending the other. Both: restaurant_id, key."""
    by = ["restaurant_id", "key"]
    short = lambda df: df.withColumn("key", F.explode(_ends(F.col("key")))).filter(F.length("key") >= 12)
    return a.join(b, by).union(short(a).join(b, by)).union(a.join(short(b), by)).drop("key")


def upsert_locations(candidates: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated, inserted). candidates and stored: id, restaurant_id, address, confidence.

    A candidate updates the stored address it is equivalent to unless that one is surer; without one it is new, once by key.
    Only keys meet, each once, by whole keys and by the ends of longer keys, never all with all: what candidates of one key can
    do the best of them does, so a key of many candidates and many stored addresses costs no more than their number.
    """
    c = candidates.filter(address_usable(F.col("address"))).select(F.col("id").alias("candidate_id"), "restaurant_id", F.col("address").alias("new_address"), F.col("confidence").alias("new_confidence"), address_key(F.col("address")).alias("key"))
    s = stored.select(F.col("id").alias("stored_id"), "restaurant_id", "confidence", address_key(F.col("address")).alias("key"))
    trust = F.coalesce(_rank(F.col("new_confidence")), F.lit(0))
    best = c.groupBy("restaurant_id", "key").agg(F.min(F.struct((-trust).alias("doubt"), (-F.length("new_address")).alias("short"), "candidate_id")).alias("best"))
    met = _equivalent(best.withColumn("new_key", F.col("key")), s.select("restaurant_id", "key").distinct().withColumn("old_key", F.col("key")))
    told = met.groupBy("restaurant_id", F.col("old_key").alias("key")).agg(F.min("best").alias("best"))
    updated = s.join(told, ["restaurant_id", "key"]).filter(-F.col("best.doubt") >= _rank(F.col("confidence"))).select("stored_id", "best.candidate_id")
    first = c.groupBy("restaurant_id", "key").agg(F.min_by(F.struct("candidate_id", "restaurant_id", "new_address", "new_confidence"), F.struct(-trust, "candidate_id")).alias("first"))
    free = first.join(met.select("restaurant_id", F.col("new_key").alias("key")), ["restaurant_id", "key"], "left_anti")
    return updated, free.select("first.*")


def locations_backfill(restaurants: DataFrame, locations: DataFrame) -> DataFrame:
    """Old addresses that the branch table doesn't have yet, as branch rows."""
    own = restaurants.filter("trim(address) <> ''").select("restaurant_id", "address")
    have = locations.select("restaurant_id", F.lower("address").alias("_a"))
    return own.withColumn("_a", F.lower("address")).join(have, ["restaurant_id", "_a"], "left_anti").drop("_a")


def location_enrich(restaurants: DataFrame, dishes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of restaurants that are done, have a city and enough dishes, and that lie in that city."""
    live = dishes.filter("deleted_at is null").groupBy("restaurant_id").agg(F.count("*").alias("live"))
    fit = restaurants.filter("status = 'done' and coalesce(trim(city), '') <> ''").select(F.col("id").alias("restaurant_id"), F.col("city").alias("_city")).join(live.filter(F.col("live") >= MIN_DISHES), "restaurant_id")
    return candidates.join(fit.select("restaurant_id", "_city"), "restaurant_id").filter(in_city(F.col("address"), F.col("_city"))).drop("_city")


def _key(address: str) -> str:
    import re
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFKD", address or "") if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _alike(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return a == b or (len(short) >= 12 and (long.startswith(short + " ") or long.endswith(" " + short)))


def _address_groups(keys: DataFrame) -> DataFrame:
    """keys: restaurant_id, key, distinct. Adds `into`: the least key of all that are linked with it, by one or more steps.

    Keys are linked if one begins or ends the other at a word's edge: each key's shorter ends meet whole keys in an equi-join.
    """
    part = keys.select("restaurant_id", F.col("key").alias("long"), F.explode(_ends(F.col("key"))).alias("key")).filter(F.length("key") >= 12)
    links = part.join(keys, ["restaurant_id", "key"]).select("restaurant_id", "key", F.col("long").alias("other"))
    links = stored(links.union(links.select("restaurant_id", "other", "key")), "links")
    label = links.select("restaurant_id", "key", F.col("key").alias("into")).distinct()
    while True:
        near = links.join(label.withColumnRenamed("key", "other"), ["restaurant_id", "other"]).groupBy("restaurant_id", "key").agg(F.min("into").alias("_near"))
        least = label.join(near, ["restaurant_id", "key"]).select("restaurant_id", "key", F.least("into", "_near").alias("_to"), F.col("into").alias("_was"))
        own = least.select("restaurant_id", F.col("key").alias("_to"), F.col("_to").alias("_next"))
        new = stored(least.join(own, ["restaurant_id", "_to"]).select("restaurant_id", "key", F.least("_to", "_next").alias("into"), "_was"), "labels")
        label = new.drop("_was")
        if new.filter("into <> _was").isEmpty():
            return keys.join(label, ["restaurant_id", "key"], "left").withColumn("into", F.coalesce("into", "key"))


def loc_dedupe(candidates: DataFrame) -> DataFrame:
    """candidates: restaurant_id, ord, label, address, latitude, longitude, confidence. Equivalent addresses merged, in order.

    Being equivalent is not transitive and the order decides, so addresses that are linked by any steps are walked together;
    the walk holds only what it keeps, whatever the number of rows. One address and one pin of a restaurant are combined.
    """
    columns = candidates.columns
    rows = candidates.filter((F.coalesce("address", F.lit("")) == "") | address_usable(F.col("address")))
    rows = rows.groupBy("restaurant_id", "address", "latitude", "longitude", "confidence", "label").agg(F.min_by(F.struct(*columns), "ord").alias("_r")).select("_r.*")
    keyed = rows.withColumn("key", F.pandas_udf(lambda a: a.map(_key), "string")("address"))
    pins = rows.filter((F.coalesce("address", F.lit("")) == "") & F.col("latitude").isNotNull() & ~F.isnan("latitude"))
    keyed = keyed.filter("key <> ''").withColumn("_at", F.col("restaurant_id"))
    # null is a restaurant too
    safe = keyed.withColumn("restaurant_id", F.coalesce(F.col("restaurant_id").cast("string"), F.lit("")))
    into = _address_groups(safe.select("restaurant_id", "key").distinct())
    grouped = safe.join(into, ["restaurant_id", "key"]).withColumn("restaurant_id", F.col("_at")).select(*columns, "key", "into")
    parts = grouped.repartition("restaurant_id", "into").sortWithinPartitions("restaurant_id", "into", "ord", "address", "confidence", "label", "latitude", "longitude")

    def walk(frames):
        group, kept = None, []
        for pdf in frames:
            done = []
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                if (at := (r["restaurant_id"], r["into"])) != group:
                    done += kept
                    group, kept = at, []
                same = next((i for i, k in enumerate(kept) if _alike(k["key"], r["key"])), None)
                if same is None:
                    kept.append(r)
                    continue
                rank = lambda x: (CONFIDENCE.get(x["confidence"], 0), len(x["address"]))
                best, other = (r, kept[same]) if rank(r) > rank(kept[same]) else (kept[same], r)
                best = dict(best)
                if not best["label"]:
                    best["label"] = other["label"]
                if best["latitude"] is None and other["latitude"] is not None:
                    best["latitude"], best["longitude"] = other["latitude"], other["longitude"]
                kept[same] = best
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(kept, columns=columns)

    named = parts.mapInPandas(walk, candidates.schema)
    only = lambda df, *cs: df.groupBy("restaurant_id").agg(F.count("*").alias("_n"), *(F.first(c).alias(f"_{c}") for c in cs)).filter("_n = 1").drop("_n")
    single = only(named, "latitude").filter("_latitude is null").select(F.col("restaurant_id").alias("_id"))
    pin = only(pins, "latitude", "longitude")
    pair = pin.join(single, F.col("restaurant_id").eqNullSafe(F.col("_id"))).select("_id", "_latitude", "_longitude")
    same = F.col("restaurant_id").eqNullSafe(F.col("_id"))
    filled = named.join(pair, same, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in ("latitude", "longitude")}).select(*columns)
    return filled.unionByName(pins.join(pair, same, "left_anti"))
