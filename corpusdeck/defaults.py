"""Default parameter values. Every operator takes its lexicon as an argument; these are the ones
used when reports in the fashion domain are wanted."""

# These lists and orders must equal the reference's for right results.

GATE = [
    "fashion", "trend", "collection", "design", "style", "wear", "couture",
    "dress", "shirt", "pants", "jeans", "jacket", "coat", "skirt", "blouse",
    "shoes", "sneakers", "boots", "heels", "accessories", "jewelry", "bag",
    "color", "fabric", "material", "textile", "print", "pattern", "silhouette",
    "season", "spring", "summer", "fall", "autumn", "winter", "resort", "cruise",
    "luxury", "premium", "sustainable", "organic", "eco-friendly", "vintage",
    "minimalist", "bohemian", "streetwear", "avant-garde", "haute-couture",
    "runway", "catwalk", "collection", "lookbook", "capsule", "bespoke",
]

SENTENCE = [
    "fashion", "style", "trend", "collection", "design", "wear",
    "dress", "shirt", "pants", "jacket", "shoes", "accessories",
]

PROTECTED_WORDS = ["wear", "new", "style", "design", "color", "fashion", "trend"]

# The English stop words of Spark ML's StopWordsRemover.
ENGLISH_STOPS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd "
    "they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't "
    "couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would "
).split()

#: Stop words unless a caller gives others.
STOPS = tuple(w for w in ENGLISH_STOPS if w not in PROTECTED_WORDS)

FACETS = {
    "season": {
        "summer": ["summer", "hot", "beach", "vacation", "sun", "lightweight", "breathable"],
        "winter": ["winter", "cold", "snow", "warm", "layered", "cozy", "insulated"],
        "spring": ["spring", "bloom", "fresh", "renewal", "light", "transitional"],
        "fall": ["fall", "autumn", "crisp", "harvest", "layering", "transition"],
    },
    "palette": {
        "pastel": ["pastel", "soft", "light", "muted", "delicate", "pale"],
        "neon": ["neon", "bright", "fluorescent", "electric", "vibrant"],
        "earth_tones": ["earth", "neutral", "natural", "organic", "earthy", "taupe", "beige"],
        "monochrome": ["monochrome", "black", "white", "gray", "grayscale", "single color"],
        "jewel": ["jewel", "rich", "sapphire", "emerald", "ruby", "amethyst", "deep"],
        "warm": ["warm", "golden", "amber", "terracotta", "rust", "spice"],
        "metallic": ["metallic", "gold", "silver", "bronze", "shiny", "glitter"],
    },
    "style_theme": {
        "boho": ["boho", "bohemian", "hippie", "flowy", "ethnic", "artistic"],
        "y2k": ["y2k", "retro", "2000s", "nostalgic", "vintage", "throwback"],
        "minimalist": ["minimalist", "simple", "clean", "essential", "basic"],
        "vintage": ["vintage", "retro", "classic", "old school", "heritage"],
        "elegant_chic": ["elegant", "chic", "sophisticated", "refined", "polished"],
    },
}

ACCESSORIES = {
    "jewelry": ["necklace", "bracelet", "earrings", "ring", "brooch"],
    "bags": ["handbag", "clutch", "tote", "backpack", "crossbody"],
    "footwear": ["shoes", "boots", "sandals", "sneakers", "heels"],
    "headwear": ["hat", "cap", "beanie", "headband", "scarf"],
    "belts": ["belt", "waistchain", "sash"],
    "eyewear": ["sunglasses", "glasses", "eyewear"],
    "tech_accessories": ["smartwatch", "fitness_tracker", "phone_case"],
    "seasonal": ["gloves", "umbrella", "shawl", "wrap"],
}

ACCESSORY_EXTRAS = ["gold", "silver", "leather", "chain", "beaded", "statement", "minimalist"]

PATTERNS = {
    "brands": ["gucci", "prada", "chanel", "dior", "versace", "nike", "adidas", "zara"],
    "materials": ["silk", "cotton", "wool", "linen", "leather", "denim", "velvet"],
    "styles": ["minimalist", "vintage", "bohemian", "streetwear", "classic", "modern"],
    "colors": ["black", "white", "red", "blue", "green", "pink", "navy"],
    "garments": ["dress", "shirt", "pants", "jacket", "skirt", "sweater"],
    "accessories": ["bag", "shoes", "jewelry", "watch", "sunglasses", "hat"],
    "patterns": ["floral", "striped", "printed", "solid", "checkered"],
}

CATEGORY_PREFIX = "fashion_"
PATTERN_LABEL = "FASHION"
PATTERN_SCORE = 0.9
PATTERN_SOURCE = "pattern_matching"
SENTIMENT_LABELS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
