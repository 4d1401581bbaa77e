"""Entity and place resolution (J16, E10-E18): blocked fuzzy matching, seeds, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.distance import match_tier, osa_distance
from .aggregates import greatest_modal

#: Occurrences that make the most frequent spelling a seed; confidence by tier.
LEAST_SEED = 5
CONFIDENCE = (1.0, 0.9, 0.75)


def _confidence(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), tier + 1)


def canonical_addresses(counts: DataFrame, roll: DataFrame | None = None) -> DataFrame:
    """(raw, key, label, confidence, lot, building, method) of every raw address with a house number.

    counts: raw, n. roll: house, street, lot, building. House number and street type must
    be equal, so they are the join key; only names of one block are compared, and each
    distinct pair of names once. The roll comes first, then the block's seed: its most
    frequent name, of equals the greatest.
    """
    normal = T.street(T.after_house_number(F.col("raw")))
    parsed = counts.groupBy("raw").agg(F.sum("n").alias("n")).select(
        "raw", "n", F.upper(T.house_number(F.col("raw"))).alias("house"), F.coalesce(T.street_type(normal), F.lit("")).alias("type"), T.street_name(normal).alias("name")
    ).where("house is not null")
    seeds = greatest_modal(parsed, ["house", "type"], "name", "n").withColumnRenamed("name", "seed").withColumnRenamed("n", "seed_n")
    names = parsed.select("house", "type", "name").distinct()
    best = None
    if roll is not None:
        r = roll.select(F.upper("house").alias("house"), F.coalesce(T.street_type(T.street(F.col("street"))), F.lit("")).alias("type"), T.street_name(T.street(F.col("street"))).alias("r_name"), "lot", "building").where("lot is not null")
        pairs = names.join(r, ["house", "type"])
        tiers = pairs.select("house", "type", "name", "r_name").distinct().withColumn("m", match_tier("name", "r_name")).where("m.tier is not null")
        best = pairs.join(tiers, ["house", "type", "name", "r_name"]).groupBy("house", "type", "name").agg(F.min(F.struct("m.tier", "m.distance", "r_name", "lot", "building")).alias("roll"))
    seeded = names.join(seeds, ["house", "type"]).withColumn("m", match_tier("name", "seed"))
    out = parsed.join(seeded, ["house", "type", "name"])
    out = out.join(best, ["house", "type", "name"], "left") if best is not None else out.withColumn("roll", F.lit(None).cast("struct<tier:int,distance:double,r_name:string,lot:string,building:string>"))
    by_roll, ok = F.col("roll").isNotNull(), F.col("seed_n") >= LEAST_SEED
    to_seed = F.when(ok, F.col("m.tier").isNotNull()).otherwise(F.col("name") == F.col("seed"))
    name = F.when(by_roll, F.col("roll.r_name")).when(to_seed, F.col("seed")).otherwise(F.col("name"))
    full = F.trim(F.concat_ws(" ", "house", name, "type"))
    confidence = F.when(by_roll, _confidence(F.col("roll.tier"))).when(~ok, 0.5).when(to_seed, _confidence(F.col("m.tier"))).otherwise(1.0)
    method = F.when(by_roll & (F.col("roll.tier") > 0), "roll").when(confidence == 1.0, "exact").otherwise("fuzzy")
    key = F.when(by_roll, F.concat(F.lit("address:bbl:"), F.col("roll.lot"))).otherwise(F.concat(F.lit("address:"), F.col("house"), F.lit("-"), T.slug(F.concat_ws(" ", name, F.col("type")))))
    return out.select("raw", key.alias("key"), T.title_case(full).alias("label"), confidence.alias("confidence"), F.col("roll.lot").alias("lot"), F.col("roll.building").alias("building"), method.alias("method"))


def canonical_orgs(counts: DataFrame, kind: str) -> DataFrame:
    """(raw, key, label, confidence, method): spellings at most one edit from the seed of their ending."""
    name, ending = T.org_parts(F.col("raw"), kind)
    parsed = counts.groupBy("raw").agg(F.sum("n").alias("n")).select("raw", "n", name.alias("name"), ending.alias("ending")).where("name <> ''")
    seeds = greatest_modal(parsed, ["ending"], "name", "n").withColumnRenamed("name", "seed").withColumnRenamed("n", "seed_n")
    near = parsed.select("name", "ending").distinct().join(seeds, "ending").withColumn("d", F.when(F.abs(F.length("name") - F.length("seed")) <= 1, osa_distance("name", "seed")))
    out = parsed.join(near, ["name", "ending"])
    ok = F.col("seed_n") >= LEAST_SEED
    same = F.col("name") == F.col("seed")
    to_seed = same | (ok & (F.col("d") <= 1))
    used = F.when(to_seed, F.col("seed")).otherwise(F.col("name"))
    confidence = F.when(~ok, 0.5).when(same, 1.0).when(to_seed, 0.9).otherwise(1.0)
    label = F.concat(T.title_case(used), F.when(F.col("ending") != "", F.concat(F.lit(" "), F.col("ending"))).otherwise(""))
    return out.select("raw", F.concat(F.lit(f"{kind}:"), T.slug(F.concat_ws(" ", used, F.col("ending")))).alias("key"), label.alias("label"), confidence.alias("confidence"), F.when(confidence == 1.0, "exact").otherwise("fuzzy").alias("method"))


def candidates(variants: DataFrame, most: int = 8) -> DataFrame:
    """Entities of one variant without a roll, with the established ones of their block that are closest in name.

    variants: entity, block, name, n_variants, backed. Established: two variants or the roll.
    """
    orphan = variants.where("n_variants = 1 and not backed").select("block", F.col("entity").alias("orphan"), F.col("name").alias("o_name"))
    known = variants.where("n_variants >= 2 or backed").select("block", "entity", "name")
    pairs = orphan.join(known, "block").withColumn("d", osa_distance("o_name", "name"))
    rank = F.row_number().over(Window.partitionBy("orphan").orderBy("d", "entity"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("orphan", "entity", "d", "rank")


def filled(new: DataFrame, old: DataFrame, key: str, *cols: str) -> DataFrame:
    """New values only where there are none yet."""
    o = old.select(key, *(F.col(c).alias(f"_{c}") for c in cols))
    return new.join(o, key, "full").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in cols))


def due(rows: DataFrame, done: DataFrame, keys: list[str], text: str, version: int) -> DataFrame:
    """Rows whose text or rules differ from what was done."""
    hashed = rows.withColumn("text_hash", F.sha1(F.coalesce(text, F.lit(""))))
    return hashed.join(done.where(F.col("version") == version).select(*keys, "text_hash"), [*keys, "text_hash"], "left_anti")


def lot_key(block: Column, lot: Column) -> Column:
    return F.concat(F.lit("1"), F.lpad(block.cast("string"), 5, "0"), F.lpad(lot.cast("string"), 4, "0"))


def block_of(key: Column) -> Column:
    return F.substring(key, 2, 5).cast("int")


def page_places(mentions: DataFrame, page: list[str], within: int = 400) -> DataFrame:
    """(page, kind, key, has_test, near, confidence): building number, else block and lot, else address.

    Of each label the first mention counts. Addresses that are an organisation's, or of
    another borough, leave the page without a place.
    """
    first = lambda label: F.min_by("norm", F.when(F.col("label") == label, F.struct("start", "norm")))
    spots = lambda label: F.collect_list(F.when(F.col("label") == label, F.col("start")))
    has = lambda label: F.max((F.col("label") == label).cast("int"))
    address = F.min(F.when(F.col("label") == "address", F.struct("start", "norm", "borough", "address_role")))
    pages = mentions.groupBy(*page).agg(first("bin").alias("bin"), first("block_lot").alias("lot"), address.alias("address"), spots("contaminant").alias("c"), spots("measurement").alias("m"), has("date").alias("d"), has("lab").alias("l"))
    parts = F.split("lot", "/")
    local = F.col("address").isNotNull() & ~F.coalesce(F.col("address.address_role") == "organisation", F.lit(False)) & (F.coalesce("address.borough", F.lit("Manhattan")) == "Manhattan")
    place = F.when(F.col("bin").isNotNull(), F.struct(F.lit("bin").alias("kind"), F.col("bin").alias("key"))).when(
        F.col("lot").isNotNull(), F.struct(F.lit("bbl").alias("kind"), lot_key(F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")).alias("key"))
    ).when(local, F.struct(F.lit("address").alias("kind"), T.street(F.col("address.norm")).alias("key")))
    test = (F.size("c") > 0) & (F.size("m") > 0)
    near = F.exists("c", lambda a: F.exists("m", lambda b: F.abs(a - b) <= within))
    confidence = F.bround(F.least(F.lit(1.0), 0.4 * test.cast("int") + 0.3 * near.cast("int") + 0.15 * F.col("d") + 0.15 * F.col("l")), 2)
    return pages.withColumn("place", place).where("place is not null").select(*page, "place.kind", "place.key", test.alias("has_test"), near.alias("near"), confidence.alias("confidence"))


def folder_places(pages: DataFrame, resolved: DataFrame, folders: DataFrame, page: list[str], folder: str) -> DataFrame:
    """Pages without a place of their own get their folder's, at .95."""
    rest = pages.join(resolved.select(*page), page, "left_anti")
    return rest.join(folders, folder).select(*page, "kind", "key", F.lit(0.95).alias("confidence"))


def preferred_label(*labels: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in labels))


# -- boroughs, folders and buildings ------------------------------------------------

# Patterns of labels, and the first block of the lots along the dividing street.
LABEL_BUILDING = (r"(?i)\bBIN\s*[:#\-]?\s*(\d{6,7})\b", r"(?i)\b(\d{7}),\s*\d+\s*/\s*\d+\b")
LABEL_LOT = r"(?i)\bBlock\s*:?\s*(\d+)\W{1,4}Lot\s*:?\s*(\d+)\b"
SHEET_BUILDING = r"(?i)\bBIN\s*[:\-]?\s*(\d{6,7})"
SHEET_LOT = r"(?i)\bB[l1Ii]ock\W{0,4}(\d+)\W{1,4}L[oO0][tTlLiI1]\W{0,4}(\d+)"
LABEL_ADDRESS = r"(?i)^\s*(\d{1,4}(?:-\d{1,4})?\s+[A-Za-z][A-Za-z0-9 .'\-]*?)(?=\s{2,}|\s+Block\b|\s+BIN\b|$)"
PERSON = r"^[A-Z][a-z'\-]+,?\s+(?:[A-Z]\.?\s+)?[A-Z][a-z'\-]+(?:\s+(?:Jr|Sr|II|III|IV)\.?)?$"
LOCATION = r"(?i)(?:job\s*location|sample\s*location|location\s*sampled|premise|property\s*address|site\s*address|sampled\s*at|address\s*sampled|location\s*of\s*sample)\s*[:\-]?\s*$"
DIVIDING_BLOCK = 196


def borough(house: Column, lot: Column, street_on_roll: Column) -> Column:
    """A roll match or a street of the roll is Manhattan; else a hyphenated number is Queens, and the rest is outside."""
    return F.when(lot.isNotNull() | F.coalesce(street_on_roll, F.lit(True)), "Manhattan").when(house.rlike(r"^\s*\d+-\d+\s*$"), "Queens").otherwise("Outside Manhattan")


def downtown_streets(roll: DataFrame) -> DataFrame:
    """Streets of which every lot's block is below the dividing one."""
    block = F.when(F.col("lot").rlike(r"^1\d{9}$"), block_of(F.col("lot")))
    return roll.select(T.street(F.col("street")).alias("street"), block.alias("block")).where("block is not null").groupBy("street").agg(F.max("block").alias("top")).where(F.col("top") < DIVIDING_BLOCK).select("street")


def is_downtown(lot: Column, street_downtown: Column) -> Column:
    """By the block of a lot, else by the street."""
    block = F.when(lot.rlike(r"^1\d{9}$"), block_of(lot))
    return F.when(block.isNotNull(), block < DIVIDING_BLOCK).otherwise(F.coalesce(street_downtown, F.lit(False)))


def accepted(matches: DataFrame, floor: float, ratio: float) -> DataFrame:
    """Proposed matches (a, b, confidence) with enough confidence and names near enough by weighted distance."""
    from ..functions.distance import weighted_distance

    near = weighted_distance("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return matches.where((F.col("confidence") >= floor) & (F.col("a") != "") & (F.col("b") != "")).where(near <= ratio)


def _place(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))


def _lot_in(text: Column, pattern: str) -> Column:
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
    return F.when(text.rlike(pattern), lot_key(part(1), part(2)))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def label_place(label: Column, sheet: Column) -> Column:
    """Struct of kind and key from a folder's label, else from its separator sheet; null for a label that is a person's name."""
    own = F.coalesce(*(_place("bin", _found(label, p)) for p in LABEL_BUILDING), _place("bbl", _lot_in(label, LABEL_LOT)))
    other = F.coalesce(_place("bin", _found(sheet, SHEET_BUILDING)), _place("bbl", _lot_in(sheet, SHEET_LOT)))
    person = ~label.rlike(r"\d") & label.rlike(PERSON)
    return F.when(F.coalesce(person, F.lit(False)), None).otherwise(F.coalesce(own, other))


def folder_table(folders: DataFrame, folder: str, roll: DataFrame | None = None) -> DataFrame:
    """(folder, kind, key) of folders (label, sheet): label, sheet, then the label's address on the roll; others are left out."""
    named = folders.withColumn("_p", label_place(F.col("label"), F.col("sheet"))).withColumn("_a", _found(F.col("label"), LABEL_ADDRESS))
    out = named.where("_p is not null").select(folder, "_p.kind", "_p.key")
    if roll is None:
        return out
    rest = named.where("_p is null and _a is not null").where(T.street_type(T.street(T.after_house_number(F.col("_a")))).isNotNull())
    found = canonical_addresses(rest.select(F.col("_a").alias("raw"), F.lit(1).alias("n")), roll).where("lot is not null").select(F.col("raw").alias("_a"), F.lit("bbl").alias("kind"), F.col("lot").alias("key"))
    return out.union(rest.join(found, "_a").select(folder, "kind", "key"))


def building_key(text: Column, buildings: Column, lots: Column, addresses: Column) -> Column:
    """Building number, else block and lot, else an address: one with a location label at most 50 characters ahead before others.

    buildings and lots: arrays of norms in order; addresses: of (start, lot, key) in order.
    """
    ahead = lambda a: F.substring(text, F.greatest(F.lit(1), a["start"] - 49), F.least(F.lit(50), a["start"]))
    labelled = F.filter(addresses, lambda a: ahead(a).rlike(LOCATION))
    used = F.when(F.size(labelled) > 0, labelled).otherwise(addresses)
    first = lambda c, f: F.get(F.transform(F.filter(c, lambda a: a[f].isNotNull()), lambda a: a[f]), F.lit(0))
    parts = F.split(F.get(lots, F.lit(0)), "/")
    lot = lot_key(F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int"))
    return F.coalesce(F.concat(F.lit("bin:"), F.get(buildings, F.lit(0))), F.concat(F.lit("bbl:"), lot), F.concat(F.lit("bbl:"), first(used, "lot")), first(used, "key"))


def rederived(old: DataFrame, new: DataFrame, label: str, page: list[str], due_pages: DataFrame) -> DataFrame:
    """Mentions after one label was derived anew for the pages that are due; other labels and pages stay."""
    renewed = old.where(F.col("label") == label).join(due_pages.select(*page), page, "left_anti")
    return old.where(~F.col("label").eqNullSafe(F.lit(label))).unionByName(renewed).unionByName(new.where(F.col("label") == label).join(due_pages.select(*page), page, "left_semi"))


def redirects(asked: DataFrame, footprint: DataFrame, with_rows: DataFrame) -> DataFrame:
    """(key, building) of asked lots whose building itself has rows; of several the smallest.

    asked: key (a lot). footprint: lot, building. with_rows: building.
    """
    known = footprint.join(with_rows.select("building").distinct(), "building", "left_semi")
    return asked.join(known, asked["key"] == known["lot"]).groupBy("key").agg(F.min("building").alias("building"))
