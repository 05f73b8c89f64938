"""Vocabularies of the extractors: words and names that results depend on."""

from __future__ import annotations

#: Known names of several words, by their last word.
NAMES = tuple((
    "Greater Los Angeles|Chicago Metropolitan Area|New York Metropolitan Area|Portland Metropolitan Area|San Francisco Bay Area|Seattle Metropolitan Area|"
    "Washington Metropolitan Area|Chesapeake Bay|San Francisco Bay|Atlantic Coast|Gulf Coast|Pacific Coast|Chihuahuan Desert|Mojave Desert|Sahara Desert|"
    "Sonoran Desert|New England|Mount Everest|H.J. Andrews Experimental Forest|Harvard Forest|Hubbard Brook Experimental Forest|Columbia River Gorge|"
    "Rio Grande|Mount St. Helens|Mount Hood|Coweeta Hydrologic Laboratory|Great Salt Lake|Lake Michigan|Mid-Atlantic|Appalachian Mountains|Rocky Mountains|"
    "Sierra Nevada|Pacific Northwest|Acadia National Park|Death Valley National Park|Denali National Park|Everglades National Park|Glacier National Park|"
    "Grand Canyon National Park|Great Smoky Mountains National Park|Joshua Tree National Park|Mount Rainier National Park|Olympic National Park|"
    "Rocky Mountain National Park|Sequoia National Park|Yellowstone National Park|Yosemite National Park|Zion National Park|Great Plains|Konza Prairie|"
    "Amazon Rainforest|Cascade Range|Jornada Experimental Range|Great Barrier Reef|Sevilleta National Wildlife Refuge|Great Lakes Region|"
    "Cedar Creek Ecosystem Science Reserve|Niwot Ridge|Colorado River|Columbia River|Hudson River|Mississippi River|Missouri River|Potomac River|"
    "Sacramento River|Snake River|Willamette River|Mount Shasta|Puget Sound|Deep South|Toolik Field Station|Lake Superior|Lake Tahoe|Central Valley|"
    "Napa Valley|Silicon Valley|Willamette Valley|Mount Whitney"
).split("|"))
MODIFIERS = tuple("upper lower inner outer central coastal greater northern southern eastern western".split())
STATES = tuple("Arizona California Colorado Montana Nevada Oregon Washington Wyoming".split())
MULTIWORD = NAMES + tuple(f"{m} {s}" for m in MODIFIERS for s in STATES)

SITE_NOUNS = tuple((
    "area|cell|city|grid|plot|site|spot|town|areas|basin|cells|field|grids|plain|plots|point|river|sites|spots|stand|towns|basins|cities|domain|fields|"
    "forest|island|plains|points|region|rivers|stands|valley|domains|estuary|forests|islands|plateau|quadrat|regions|station|valleys|location|mountain|"
    "plateaus|quadrats|stations|transect|catchment|estuaries|locations|mountains|transects|watershed|catchments|urban area|watersheds|urban areas"
).split("|"))
STUDY_VERBS = tuple((
    "base|span|cover|focus|found|place|study|assess|center|centre|create|extend|gather|locate|obtain|record|sample|set up|survey|analyse|analyze|collect|"
    "conduct|examine|include|install|measure|monitor|observe|perform|situate|evaluate|position|carry out|encompass|establish|undertake|concentrate|"
    "investigate"
).split("|"))
SITE_PREPS = tuple("at|in|on|from|near|over|along|across|around|within|throughout".split("|"))
FOCUS_VERBS, SET_VERBS = ("center", "centre", "focus", "concentrate"), ("locate", "situate", "position", "establish")
DATA_NOUNS, DATA_VERBS = ("data", "datum", "sample", "samples", "measurement", "measurements", "observation", "observations"), ("take", "gather", "obtain", "record", "collect")
DOMAIN_NOUNS, DOMAIN_VERBS = ("area", "model", "region", "domain"), ("span", "cover", "extend", "include", "encompass")

UNITS = tuple("m|km|mi|miles|meters|metres|kilometers|kilometres".split("|"))
DIRECTIONS = tuple("e|n|s|w|ne|nw|se|sw|east|west|north|south|northeast|northwest|southeast|southwest|inland|onshore|offshore|upstream|downstream".split("|"))
NEARNESS = tuple("near|next|close|beside|nearby|adjacent|neighboring|neighbouring".split("|"))
CONTAINMENT = tuple("around|inside|within|outside|surrounding".split("|"))
TOWARDS = tuple("of|to|from".split("|"))
PLACING_PREPS = tuple("at|in|on|near|over|along|across|through".split("|"))
PLACING_VERBS = tuple("set|found|placed|located|situated|positioned|established".split("|"))
DESCRIPTORS = tuple("area|zone|basin|locale|region|sector|district|vicinity|territory|neighborhood|neighbourhood".split("|"))

#: Words after which the first name is taken for a place.
INDICATORS = tuple("area site found region located station vicinity situated positioned".split())
#: Words of a context that speak of places.
GEO_WORDS = frozenset((
    "area|hill|lake|plot|site|zone|areas|coast|field|ocean|plots|river|sites|study|zones|forest|island|region|survey|valley|located|plateau|quadrat|regions|"
    "station|altitude|latitude|location|mountain|quadrats|research|sampling|situated|stations|transect|elevation|locations|longitude|transects|coordinate|"
    "monitoring|positioned|coordinates|established|measurement"
).split("|"))
#: A stop after one of these ends no sentence.
ABBREVIATIONS = frozenset((
    "n|p|ca|cf|cm|dr|eq|ha|jr|kg|km|mg|ml|mm|no|pp|sp|sr|vs|alt|apr|aug|dec|e.g|eqs|est|etc|feb|fig|gen|i.e|jan|jul|jun|lat|lon|m.d|mar|max|min|nov|oct|sep|"
    "spp|tab|var|viz|vol|b.sc|elev|figs|ibid|m.sc|ph.d|prof|sept|tabs|temp|et al|subsp|suppl|approx|appendix"
).split("|"))


def forms(verb: str) -> str:
    """A pattern for the forms of an English verb."""
    first, _, rest = verb.partition(" ")
    odd = {"take": "(?:take[ns]?|took|taking)", "found": "found(?:ed|ing|s)?", "undertake": "(?:undertake[ns]?|undertook|undertaking)", "set": "set(?:s|ting)?", "carry": "carr(?:y|ies|ied|ying)"}
    one = odd.get(first) or (first[:-1] + "(?:y|ies|ied|ying)" if first.endswith("y") and first[-2] not in "aeiou" else (first[:-1] if first.endswith("e") else first) + "(?:e|es|ed|ing|s|ses|sed|sing)?")
    return one + (r"\s+" + rest if rest else "")
