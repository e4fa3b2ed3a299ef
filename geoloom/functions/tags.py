"""Columns derived from a map of free-form tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys whose value makes a category, in order.
CATEGORY_KEYS = (
    "amenity", "shop", "tourism", "leisure", "office", "craft", "healthcare", "social_facility", "historic", "man_made", "aeroway", "public_transport", "emergency",
    "place", "building", "natural", "landuse", "waterway", "power", "railway", "highway", "barrier", "entrance", "playground", "club", "gambling", "advertising",
)
# Keys that are a category by themselves when they only say yes and the object has a name.
BARE_KEYS = ("building", "natural", "landuse")
# Keys that hold names, in order; keys 'name:*' follow.
NAME_KEYS = ("name", "alt_name", "short_name", "official_name", "brand", "operator", "old_name")
# Parts of an address and the keys that hold them.
ADDRESS_PARTS = ("housenumber", "street", "unit", "city", "state", "postcode", "country")
# Relation networks and their bit.
NETWORK_BITS = {"ncn": 1, "rcn": 2, "lcn": 4, "mtb": 8}
EMPTY = "cast(array() as array<string>)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def categories(tags: Column | str) -> Column:
    """'key/value' of each category key, then 'cuisine/x' of each ';'-separated cuisine; blank cuisines keep ''."""
    t = _c(tags)
    found = []
    for key in CATEGORY_KEYS:
        value = t[key]
        plain = F.when(~value.isin("yes", "no"), F.concat(F.lit(f"{key}/"), value))
        found.append(plain.when((value == "yes") & t["name"].isNotNull(), F.lit(key)) if key in BARE_KEYS else plain)
    dishes = F.filter(F.split(t["cuisine"], ";"), lambda x: x != "")
    dishes = F.transform(dishes, lambda x: F.concat(F.lit("cuisine/"), F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.concat(F.array_compact(F.array(*found)), F.coalesce(dishes, F.expr(EMPTY)))


def names(tags: Column | str) -> Column:
    """Distinct names in the order of `NAME_KEYS`, then those of 'name:*' sorted by key."""
    t = _c(tags)
    local = F.transform(F.array_sort(F.map_entries(F.map_filter(t, lambda k, v: k.startswith("name:")))), lambda e: e["value"])
    return F.array_distinct(F.array_compact(F.concat(F.array(*[t[k] for k in NAME_KEYS]), local)))


def admin_level(tags: Column | str) -> Column:
    t = _c(tags)
    return F.when(t["boundary"] == "administrative", t["admin_level"].try_cast("int"))


def object_id(osm_type: Column | str, osm_id: Column | str) -> Column:
    """'node/1' and the like from the one-letter type."""
    kind = F.when(_c(osm_type) == "N", "node").when(_c(osm_type) == "W", "way").when(_c(osm_type) == "R", "relation").when(_c(osm_type) == "X", "intersection")
    return F.concat_ws("/", kind, _c(osm_id).cast("string"))


def address(tags: Column | str) -> Column:
    """A struct of address parts where street or house number is given."""
    t = _c(tags)
    given = t["addr:street"].isNotNull() | t["addr:housenumber"].isNotNull()
    return F.when(given, F.struct(*[t[f"addr:{p}"].alias(p) for p in ADDRESS_PARTS]))


def first_values(tags: Column | str, *keys: str) -> Column:
    """The non-null values of `keys` in order; null where there is none."""
    found = F.array_compact(F.array(*[_c(tags)[k] for k in keys]))
    return F.when(F.size(found) > 0, found)


def phones(tags: Column | str) -> Column:
    return first_values(tags, "phone", "contact:phone", "contact:mobile")


def websites(tags: Column | str) -> Column:
    return first_values(tags, "website", "contact:website", "url")


def bicycle_class(tags: Column | str) -> Column:
    """struct(infra, state) of a way: its kind of bicycle infrastructure and whether it is proposed or being built."""
    t = _c(tags)
    road, lane, bike = t["highway"], t["cycleway"], t["bicycle"]
    left, right = F.coalesce(t["cycleway:left"], t["cycleway:both"]), F.coalesce(t["cycleway:right"], t["cycleway:both"])
    is_ = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    any_side = lambda v: is_(lane, v) | is_(left, v) | is_(right, v)
    state = F.when(any_side("proposed") | t["proposed:cycleway"].isNotNull(), "proposed").when(any_side("construction") | t["construction:cycleway"].isNotNull(), "construction")
    as_ = lambda infra, state_=None: F.struct(F.lit(infra).cast("string").alias("infra"), (F.lit(state_) if isinstance(state_, str) or state_ is None else state_).cast("string").alias("state"))
    planned = is_(t["proposed"], "cycleway") | is_(t["proposed:highway"], "cycleway") | t["proposed:bicycle"].isNotNull()
    built = is_(t["construction"], "cycleway") | is_(t["construction:highway"], "cycleway")
    allowed = road.isNotNull()
    return (
        F.when(is_(road, "proposed"), F.when(planned, as_("cycleway", "proposed")).otherwise(as_(None)))
        .when(is_(road, "construction"), F.when(built, as_("cycleway", "construction")).otherwise(as_(None)))
        .when(is_(road, "cycleway"), as_("cycleway", state))
        .when(is_(t["bicycle_road"], "yes"), as_("bicycle_road", state))
        .when(is_(t["cyclestreet"], "yes"), as_("cycle_street", state))
        .when(any_side("track"), as_("cycle_track", state))
        .when(any_side("lane"), as_("cycle_lane", state))
        .when(any_side("shared_lane"), as_("shared_lane", state))
        .when(is_(lane, "opposite", "opposite_lane", "opposite_track"), as_("opposite", state))
        .when(is_(lane, "shoulder") | is_(t["shoulder:bicycle"], "yes"), as_("shoulder", state))
        .when(state.isNotNull(), as_("cycle_lane", state))
        .when(is_(road, "path", "footway", "bridleway") & is_(bike, "designated"), as_("path_bicycle"))
        .when(is_(road, "steps") & (is_(t["ramp:bicycle"], "yes") | is_(bike, "yes", "designated")), as_("steps_bicycle"))
        .when(is_(bike, "designated") & allowed, as_("bicycle_designated"))
        .when(is_(bike, "yes") & allowed, as_("bicycle_yes"))
        .otherwise(as_(None))
    )


def oneway(tags: Column | str) -> Column:
    value = _c(tags)["oneway"]
    return F.when(value.isin("yes", "1"), 1).when(value == "-1", -1).otherwise(0)


def is_set(tags: Column | str, key: str) -> Column:
    """Given and not 'no'."""
    return F.coalesce(_c(tags)[key] != "no", F.lit(False))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of halves towards plus infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + 0.5) / scale


def numeric_prefix(text: Column | str, decimals: bool) -> Column:
    return F.nullif(F.regexp_extract(_c(text), r"^\d*\.?\d*" if decimals else r"^\d*", 0), F.lit(""))


def speed_kph(text: Column | str) -> Column:
    """A speed in km/h, miles converted; null outside 10 to 150."""
    s = _c(text)
    number = numeric_prefix(s, False).try_cast("double")
    kph = F.when(s.endswith("mph"), half_up(number * 1.609344)).otherwise(number)
    return F.when(kph.between(10, 150), kph)


def weight_t(text: Column | str) -> Column:
    """A weight in tons: pounds and kilograms converted, other units read as tons."""
    w = F.regexp_replace(_c(text), r"\s+", "")
    number = numeric_prefix(w, True)
    value = number.try_cast("double")
    unit = F.substring(w, F.length(number) + 1, F.length(w))
    return half_up(F.when(unit.isin("lb", "lbs"), value / 2000).when(unit == "kg", value / 1000).otherwise(value), 2)


def measure_m(text: Column | str) -> Column:
    """A length in metres: plain numbers, or sums of numbers with m, cm, ft and in; null for other units."""
    m = F.replace(_c(text), F.lit(","), F.lit("."))
    pattern = r"(\d+\.?\d*) *([a-zA-Z\"']*)"
    numbers = F.regexp_extract_all(m, F.lit(pattern), F.lit(1))
    units = F.transform(F.regexp_extract_all(m, F.lit(pattern), F.lit(2)), F.lower)

    def metres(n: Column, u: Column) -> Column:
        factor = F.when(u.isin("m", "meter", "meters"), 1.0).when(u == "cm", 0.01).when(u.isin("ft", "feet", "foot", "'"), 0.3048).when(u.isin("in", "inches", "inch", '"', "''"), 0.0254)
        return n.try_cast("double") * factor

    parts = F.zip_with(numbers, units, metres)
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    return half_up(F.coalesce(m.try_cast("double"), F.when(F.size(parts) > 0, total)), 2)


def restriction_type(text: Column | str) -> Column:
    """The part of a conditional restriction before '@' as long as its letters without blanks; null without '@'."""
    s = _c(text)
    head = F.substring_index(s, "@", 1)
    return F.when(s.contains("@"), F.substring(s, F.lit(1), F.length(F.replace(head, F.lit(" "), F.lit("")))))


def restriction_times(text: Column | str) -> Column:
    """The part after '@' from its first sign that is no blank; null without '@'."""
    s = _c(text)
    return F.when(s.contains("@"), F.regexp_replace(F.substring(s, F.instr(s, "@") + 1, F.length(s)), "^ +", ""))


def any_of(table: dict[str, str], keys: Column | str) -> Column:
    """The value of a ';'-separated key list in a fixed table: the whole list's, else 'true' if any part has it, else
    the last part's found."""
    k = _c(keys)
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = F.array_compact(F.transform(F.filter(F.split(k, ";"), lambda p: p != ""), lambda p: lookup[p]))
    return F.coalesce(lookup[k], F.when(F.array_contains(parts, "true"), "true"), F.try_element_at(parts, F.lit(-1)))


def cash_only(tags: Column | str) -> Column:
    """Whether cash is taken and nothing else; 'no' in any case is the only refusal."""
    pay = F.map_filter(_c(tags), lambda k, v: k.startswith("payment:") & (F.upper(v) != "NO"))
    kinds = F.map_keys(pay)
    cash = [f"payment:{x}" for x in ("cash", "notes", "coins")]
    return F.exists(kinds, lambda k: k.isin(*cash)) & ~F.exists(kinds, lambda k: ~k.isin(*cash))


def levels(text: Column | str) -> Column:
    """The numeric levels of a ';'-separated list."""
    return F.array_compact(F.transform(F.split(_c(text), ";"), lambda x: F.trim(x).try_cast("double")))


def is_underground(text: Column | str) -> Column:
    return F.exists(levels(text), lambda x: x < 0)


def lowest_level(text: Column | str) -> Column:
    return F.array_min(levels(text))


def network_mask(networks: Column | str) -> Column:
    """Bits of a list of bicycle networks."""
    return F.aggregate(F.array_distinct(_c(networks)), F.lit(0), lambda m, n: m.bitwiseOR(F.coalesce(F.create_map(*[F.lit(x) for p in NETWORK_BITS.items() for x in p])[n], F.lit(0))))
