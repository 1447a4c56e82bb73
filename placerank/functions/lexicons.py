"""Word lists, lookup tables and patterns whose content decides results.

Nothing here is logic.  The order of the entries matters wherever first match wins.
"""

from __future__ import annotations

# --- dates -------------------------------------------------------------------------------------
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov",
    "dec",
]

# --- names -------------------------------------------------------------------------------------
LEGAL_WORDS = [
    "pte", "ltd", "llp", "llc", "inc", "sg", "singapore", "sgp",
]
NOISE_WORDS = [
    "restaurant", "restaurants", "cafe", "coffee", "bar", "bistro", "kitchen", "eatery", "eating", "house",
    "place", "the", "pte", "ltd", "llp", "sg", "singapore", "sgp", "outlet", "branch", "seafood", "food",
    "stall", "and",
]
ARTICLES = ["the", "a", "an"]
SKIP_HEADINGS = (
    "conclusion", "final thoughts", "summary", "faq", "faqs", "related articles", "read more",
    "share this", "comments", "also read", "table of contents", "contents", "overview", "verdict",
    "the verdict", "photos", "location", "how to get there", "about the author",
)

# --- cuisines: label -> spellings, first match in this order ------------------------------------
CUISINE_SPELLINGS = {
    "Zi Char": ["zi char", "zichar", "tze char", "cze char", "煮炒", "zi-char"],
    "Dim Sum": ["dim sum", "dimsum", "点心", "yum cha"],
    "Hotpot": ["hotpot", "hot pot", "steamboat", "火锅", "mookata", "mala"],
    "Chinese": ["chinese", "chinese_restaurant", "cantonese", "teochew", "hokkien", "sichuan",
                "szechuan", "hainanese"],
    "Seafood": ["seafood", "seafood_restaurant", "crab"],
    "Cafe": ["cafe", "café", "cafes", "coffee", "coffee_shop", "cafes & coffee", "bakery", "brunch"],
    "Dessert": ["dessert", "desserts", "ice cream", "ice_cream_shop", "patisserie", "cake"],
    "High Tea": ["high tea", "afternoon tea"],
    "Bar": ["bar", "bars", "cocktail", "wine bar", "pub", "rooftop bar"],
    "Japanese": ["japanese", "japanese_restaurant", "sushi", "sushi_restaurant", "ramen",
                 "ramen_restaurant", "omakase", "izakaya"],
    "Korean": ["korean", "korean_restaurant", "kbbq"],
    "Thai": ["thai", "thai_restaurant"],
    "Vietnamese": ["vietnamese", "vietnamese_restaurant", "pho"],
    "Indian": ["indian", "indian_restaurant", "north indian", "south indian"],
    "Malay": ["malay", "nasi lemak", "nasi padang"],
    "Peranakan": ["peranakan", "nyonya", "nonya"],
    "Indonesian": ["indonesian", "indonesian_restaurant"],
    "Western": ["western", "grill", "steakhouse", "steak_house", "american", "american_restaurant",
                "burger", "hamburger_restaurant"],
    "Italian": ["italian", "italian_restaurant", "pizza", "pizza_restaurant", "pasta"],
    "French": ["french", "french_restaurant"],
    "Spanish": ["spanish", "spanish_restaurant", "tapas"],
    "Mediterranean": ["mediterranean", "mediterranean_restaurant", "greek", "greek_restaurant",
                      "middle eastern", "middle_eastern_restaurant", "turkish", "lebanese"],
    "Mexican": ["mexican", "mexican_restaurant"],
    "Fine Dining": ["fine dining", "fine_dining_restaurant", "tasting menu", "degustation"],
    "Buffet": ["buffet", "buffet_restaurant"],
    "Hawker": ["hawker", "hawker centre", "hawker center", "food court", "food_court", "kopitiam",
               "coffee shop"],
    "Vegetarian": ["vegetarian", "vegetarian_restaurant", "vegan", "vegan_restaurant"],
    "Halal": ["halal"],
    "Local": ["local", "singaporean", "singapore cuisine"],
    "Asian": ["asian", "asian_restaurant", "pan asian", "fusion"],
    "Restaurant": ["restaurant", "food"],
}
SPECIFIC_CUISINES = ["Zi Char", "Dim Sum", "Hotpot", "High Tea", "Dessert", "Hawker", "Buffet",
                     "Fine Dining", "Cafe", "Bar"]

# --- cuisine tabs of the served site: label -> pattern, in display order --------------------------
CUISINE_TABS = {
    "Japanese": r"japanese|sushi|sashimi|omakase|ramen|udon|\bsoba\b|izakaya|yakitori|yakiniku|tempura|tonkatsu|donburi|kaiseki|unagi|teppanyaki|robata",
    "Chinese": r"chinese|cantonese|szechuan|sichuan|hokkien|teochew|hakka|hainanese|dim sum|dumpling|xiao long bao|zi ?char|peking duck|roast duck|char siew|wonton|\bmala\b|hot ?pot|steamboat|bak kut teh|congee",
    "Korean": r"korean|kimchi|bibimbap|bulgogi|tteok|soju",
    "Thai": r"\bthai\b|tom yum|pad thai|som tam|boat noodle",
    "Vietnamese": r"vietnam|\bpho\b|banh mi|bun cha",
    "Indian": r"indian|biryani|briyani|prata|naan|tandoori|masala|dosa|thosai|banana leaf|fish head curry",
    "Malay & Indonesian": r"\bmalay|\bnasi\b|satay|rendang|indonesian|mee rebus|mee soto|ayam penyet",
    "Peranakan": r"peranakan|nyonya|nonya|buah keluak|kueh",
    "Local & hawker": r"hawker|food cent(?:re|er)|kopitiam|chicken rice|char kway teow|hokkien mee|bak chor mee|carrot cake|kaya toast|laksa|rojak|prawn mee|fishball|wanton mee|singaporean",
    "Italian": r"italian|pasta|pizz|trattoria|osteria|risotto|tiramisu",
    "French": r"french(?! toast)|bistro|brasserie|cr[eê]perie|patisserie",
    "Spanish": r"spanish|tapas|paella",
    "Mexican": r"mexican|\btacos?\b|burrito|quesadilla",
    "Mediterranean & Middle Eastern": r"mediterranean|greek|taverna|lebanese|turkish|kebab|mezze|hummus|shawarma|falafel|persian|middle eastern",
    "Western": r"western|steak|burger|\bbbq\b|barbecue|fish (?:and|&) chips|rotisserie|smokehouse",
    "Seafood": r"seafood|chill?i crab|pepper crab|lobster|oyster",
    "Desserts": r"dessert|ice cream|gelato|soft serve|waffle|bingsu|patisserie|pastr(?:y|ies)|sorbet|frozen yogurt|chocolate|cheesecake|cake shop",
}

# --- review aspects -----------------------------------------------------------------------------
ASPECTS = {
    "food": {
        "pos": ["delicious", "tasty", "yummy", "flavourful", "flavorful", "fresh", "generous",
                "must try", "must-try", "excellent", "amazing", "best", "perfect", "superb",
                "wok hei", "shiok", "good"],
        "neg": ["bland", "soggy", "overcooked", "undercooked", "stale", "greasy", "oily", "salty",
                "cold food", "tasteless", "small portion", "disappointing", "mediocre", "average"],
    },
    "service": {
        "pos": ["attentive", "friendly", "prompt", "helpful", "warm", "efficient", "welcoming",
                "polite", "quick", "fast"],
        "neg": ["rude", "slow", "ignored", "unfriendly", "long wait", "waited", "forgot",
                "inattentive", "pushy", "chaotic"],
    },
    "ambience": {
        "pos": ["cosy", "cozy", "romantic", "beautiful", "stunning", "charming", "relaxing",
                "lovely", "chill", "instagrammable", "gorgeous", "quiet", "spacious", "comfortable"],
        "neg": ["noisy", "loud", "cramped", "stuffy", "hot", "dirty", "dated", "crowded", "smoky",
                "uncomfortable"],
    },
    "value": {
        "pos": ["worth", "affordable", "reasonable", "value for money", "value-for-money", "cheap",
                "good value", "wallet friendly", "budget"],
        "neg": ["expensive", "overpriced", "pricey", "not worth", "rip off", "rip-off", "steep",
                "costly"],
    },
}
NEGATORS = ["not", "no", "never", "isn't", "wasn't", "aren't", "weren't", "too"]
QUIET_WORDS = ["quiet", "peaceful", "serene", "tranquil", "calm", "intimate"]
LOUD_WORDS = ["noisy", "loud", "crowded", "bustling", "rowdy", "packed"]
# the scoring component counts substrings of a different list than the noise level above
NOISE_QUIET = ["quiet", "peaceful", "serene", "intimate", "tranquil"]
NOISE_LOUD = ["loud", "noisy", "crowded", "bustling", "rowdy"]
AMBIENCE_WORDS = {
    "romantic": ["romantic", "date night", "candlelit", "intimate"],
    "quiet": ["quiet", "peaceful", "serene", "tranquil"],
    "lively": ["lively", "buzzing", "bustling", "vibrant"],
    "rooftop": ["rooftop", "roof top", "sky bar"],
    "waterfront": ["waterfront", "riverside", "by the river", "seaside", "marina", "bayfront",
                   "by the sea", "beachfront"],
    "garden": ["garden", "greenery", "alfresco", "al fresco"],
    "heritage": ["heritage", "shophouse", "colonial", "conservation", "black and white bungalow"],
    "cosy": ["cosy", "cozy", "homely"],
    "view": ["view", "skyline", "sunset"],
}
PRIVATE_ROOM = r"private (?:dining )?rooms?|private dining|function room|包厢|包间"
SOCIAL_WORDS = ["tiktok", "instagram", "insta worthy", "insta-worthy", "instaworthy", "viral",
                "ig-worthy", "小红书", "xiaohongshu"]
REVIEW_SOCIAL_WORDS = ["tiktok", "instagram", "insta worthy", "insta-worthy", "viral"]

# --- filters ------------------------------------------------------------------------------------
NOT_A_PLACE = (
    r"\((?:temporarily |permanently )?closed\)|\bpermanently closed\b"
    r"|^\W*\d*\W*$|^(?:north|south|east|west|central) singapore$"
    r"|\b(?:mall|plaza|jewellers?|museum)\b|\bshopping (?:centre|center)\b"
)
HOTEL = (
    r"\b(?:hotel|resort|mandarin oriental|ritz-carlton|fullerton|raffles|st\.? regis|shangri-la|"
    r"four seasons|conrad|swissotel|pan pacific|intercontinental|capella)\b"
)
FESTIVE_WORDS = ["christmas", "festive", "new year", "cny", "chinese new year", "deepavali",
                 "hari raya", "mooncake"]

# --- prices -------------------------------------------------------------------------------------
PRICE_ENUM = {
    "PRICE_LEVEL_FREE": 1,
    "PRICE_LEVEL_INEXPENSIVE": 1,
    "PRICE_LEVEL_MODERATE": 2,
    "PRICE_LEVEL_EXPENSIVE": 3,
    "PRICE_LEVEL_VERY_EXPENSIVE": 4,
}
FOREIGN_MONEY = r"\bRM\s*\d|\bMYR\b|\bTHB\b|฿|\bIDR\b|\bRp\s*\d|US\$|\bUSD\b|HK\$|NT\$|\bJPY\b|¥|€|£"

# --- awards -------------------------------------------------------------------------------------
AWARD_MENTION = (
    r"\b(bib[- ]gourmand)\b|\b(one|two|three|[123])[- ]michelin[- ](?:stars?|starred)\b"
    r"|\b(michelin[- ]starred)\b"
)
OTHER_PLACE = (
    r"\b(?:chef (?:of|at|from)|head chef|behind|brought us|fans of|led|leads|alum(?:ni)? of|former|"
    r"sister|same|team (?:of|from|behind)|trained (?:at|under)|worked (?:at|in)|creators? of|"
    r"owners? of|sibling|founders? of|outpost of|branch of)\b"
)
PERSON_AFTER = (
    r"^[\s,]*(?:award-winning\s+)?(?:chefs?|vision|team|founders?|owners?|restaurateurs?)\b"
)

# --- article relevance --------------------------------------------------------------------------
FOOD_SLUG = (
    r"(?:^|[-/])(?:food|foodie|eat|eats|eatery|eateries|restaurant|cafe|coffee|dining|dine|dinner|"
    r"lunch|buffet|hawker|brunch|dim-sum|dimsum|steamboat|hotpot|hot-pot|zi-char|zichar|dessert|"
    r"high-tea|tea|bakery|bakeries|bakehouse|omakase|menu|steak|steakhouse|sushi|ramen|bbq|"
    r"seafood|noodle|laksa|bistro|brasserie|kitchen|cuisine|halal|vegetarian|pizza|burger|"
    r"dumpling|kopitiam|bar|bars|supper|ice-cream|gelato|korean|japanese|chinese|thai|italian|"
    r"indian|western)s?(?=[-/]|$)"
)
OVERSEAS_SLUG = (
    r"(?:^|[-/])(?:johor|jb|malaysia|kuala-lumpur|kl|penang|melaka|malacca|batam|bintan|bali|"
    r"seminyak|phuket|bangkok|thailand|hong-kong|taipei|taiwan|tokyo|osaka|japan|seoul|korea)"
    r"(?=[-/]|$)"
)
NEWNESS_QUERY = r"(?i)(?:^|\s)(?:new|newly|latest|openings?|opened)(?=\s|$)"
NEWNESS_SLUG = (
    r"(?:^|[-/])(?:new|opening|openings|opened|latest|january|february|march|april|may|june|"
    r"july|august|september|october|november|december|20\d\d)(?=[-/]|$)"
)
GENERIC_QUERY_WORDS = [
    "best", "top", "singapore", "sg", "for", "a", "an", "the", "in", "of", "and", "with", "to", "near", "new",
    "places", "spots", "guide", "date", "night", "couples", "couple", "family", "families", "kids", "weekend",
    "instagrammable", "tiktok", "viral", "group", "latest", "newly", "opened", "openings", "this", "month",
]
FOOD_QUERY_WORDS = [
    "restaurant", "food", "cafe", "place", "spot", "dining", "eat", "eatery",
]
LISTICLE_WORDS = ["best", "top", "guide", "places", "cafes", "restaurants"]

# --- threads ------------------------------------------------------------------------------------
GENERIC_STARTS = [
    "I", "The", "This", "That", "It", "Singapore", "Reddit", "Edit", "Also", "Yes", "No", "Not", "Best",
    "Good", "Great", "Nice", "Try", "Go", "Google", "Michelin", "Instagram", "TikTok", "MRT", "CBD",
    "Orchard", "Chinatown", "East", "West", "North", "South",
]
AREA_NAMES = [
    "commonwealth", "bukit timah", "tiong bahru", "katong", "joo chiat", "tanjong pagar",
    "holland village", "holland v", "jurong", "jurong east", "jurong west", "tampines", "bedok",
    "punggol", "sengkang", "woodlands", "yishun", "ang mo kio", "amk", "bishan", "toa payoh",
    "clementi", "queenstown", "novena", "dempsey", "dempsey hill", "sentosa", "bugis", "kallang",
    "geylang", "serangoon", "hougang", "pasir ris", "changi", "marina bay", "raffles place",
    "robertson quay", "clarke quay", "boat quay", "little india", "kampong glam", "arab street",
    "haji lane", "keong saik", "duxton", "telok ayer", "amoy street", "orchard road", "somerset",
    "dhoby ghaut", "city hall", "bras basah", "outram", "redhill", "alexandra", "east coast",
    "siglap", "marine parade", "upper thomson", "thomson", "seletar", "sembawang", "choa chu kang",
    "bukit batok", "bukit panjang", "boon lay", "tuas", "harbourfront", "vivocity", "jalan besar",
    "lavender", "farrer park", "macpherson", "paya lebar", "ubi", "eunos", "kembangan", "simei",
    "tanah merah", "expo", "buona vista", "one north", "one-north", "kent ridge", "pasir panjang",
    "labrador park", "west coast", "ghim moh", "beauty world", "sixth avenue", "stevens", "newton",
    "tanglin", "river valley", "great world", "mount faber",
]

# --- postal sectors: (planning district, region, first two digits) --------------------------------
POSTAL_SECTORS = [
    ("D01 Raffles Place / Marina", "Central", "01 02 03 04 05 06"),
    ("D02 Tanjong Pagar / Chinatown", "Central", "07 08"),
    ("D03 Queenstown / Tiong Bahru", "Central", "14 15 16"),
    ("D04 Harbourfront / Telok Blangah", "Central", "09 10"),
    ("D05 Pasir Panjang / Clementi", "West", "11 12 13"),
    ("D06 City Hall / Clarke Quay", "Central", "17"),
    ("D07 Bugis / Beach Road", "Central", "18 19"),
    ("D08 Little India / Farrer Park", "Central", "20 21"),
    ("D09 Orchard / River Valley", "Central", "22 23"),
    ("D10 Tanglin / Holland / Bukit Timah", "Central", "24 25 26 27"),
    ("D11 Novena / Newton / Thomson", "Central", "28 29 30"),
    ("D12 Balestier / Toa Payoh", "Central", "31 32 33"),
    ("D13 Macpherson / Potong Pasir", "Central", "34 35 36 37"),
    ("D14 Geylang / Paya Lebar", "Central", "38 39 40 41"),
    ("D15 Katong / Joo Chiat / Marine Parade", "East", "42 43 44 45"),
    ("D16 Bedok / Upper East Coast", "East", "46 47 48"),
    ("D17 Changi / Loyang", "East", "49 50 81"),
    ("D18 Tampines / Pasir Ris", "East", "51 52"),
    ("D19 Serangoon / Hougang / Punggol", "North East", "53 54 55 82"),
    ("D20 Ang Mo Kio / Bishan", "North East", "56 57"),
    ("D21 Upper Bukit Timah / Clementi Park", "West", "58 59"),
    ("D22 Jurong / Boon Lay", "West", "60 61 62 63 64"),
    ("D23 Bukit Batok / Choa Chu Kang", "West", "65 66 67 68"),
    ("D24 Lim Chu Kang / Tengah", "West", "69 70 71"),
    ("D25 Woodlands / Admiralty", "North", "72 73"),
    ("D26 Upper Thomson / Springleaf", "North", "77 78"),
    ("D27 Yishun / Sembawang", "North", "75 76"),
    ("D28 Seletar / Yio Chu Kang", "North East", "79 80"),
]
