"""Word lists, aliases, factors and display orders.

They decide which results come out, so they are spelled out here, together and in
their natural order.
"""

from __future__ import annotations

# Grocery categories and the keywords of each.
CATEGORY_KEYWORDS = [
    ("Meat & Seafood", [
        "chicken", "beef", "pork", "steak", "ground meat", "turkey", "lamb", "bacon", "sausage", "ham", "salmon", "shrimp", "fish", "tuna",
        "prosciutto", "chorizo", "meatball",
    ]),
    ("Dairy", [
        "milk", "cheese", "butter", "cream", "yogurt", "sour cream", "mozzarella", "parmesan", "cheddar", "ricotta", "feta", "cream cheese",
        "half-and-half", "whipping cream", "egg", "eggs",
    ]),
    ("Produce", [
        "garlic", "onion", "tomato", "potato", "pepper", "lettuce", "spinach", "carrot", "celery", "broccoli", "zucchini", "squash", "mushroom",
        "avocado", "lemon", "lime", "orange", "apple", "banana", "berry", "basil", "cilantro", "parsley", "thyme", "rosemary", "dill", "mint",
        "chive", "scallion", "shallot", "ginger", "jalapeño", "poblano", "corn", "cucumber", "cabbage", "kale", "arugula", "radish",
        "sweet potato", "green bean", "asparagus", "pea", "beet", "herb", "fresh",
    ]),
    ("Bakery", ["bread", "tortilla", "bun", "roll", "pita", "naan", "bagel", "croissant", "baguette"]),
    ("Frozen", ["frozen"]),
    ("Drinks", [
        "wine", "beer", "bourbon", "whiskey", "vodka", "rum", "tequila", "juice", "soda", "sparkling water", "seltzer", "tonic", "lemonade",
        "kombucha", "cider",
    ]),
    ("Pantry", [
        "oil", "olive oil", "vinegar", "flour", "sugar", "salt", "pepper", "paprika", "cumin", "oregano", "cinnamon", "chili powder", "cayenne",
        "turmeric", "nutmeg", "pasta", "rice", "orzo", "noodle", "quinoa", "couscous", "broth", "stock", "sauce", "paste", "powder", "bean",
        "lentil", "chickpea", "honey", "maple syrup", "mustard", "ketchup", "mayo", "breadcrumb", "panko", "cornstarch", "baking", "sriracha",
        "worcestershire", "extract", "seasoning", "sesame", "peanut butter", "almond", "walnut", "pecan", "coconut", "vanilla", "chocolate",
        "cocoa", "tortilla", "tortillas", "wrap", "wraps", "chips",
    ]),
]

# Order of the categories on a shopping list; others are left out of it.
CATEGORY_ORDER = ["Produce", "Meat & Seafood", "Dairy", "Bakery", "Frozen", "Drinks", "Pantry", "Misc"]

# Words taken out of an ingredient's name, one after the other.
STRIP_WORDS = [
    "fresh", "dried", "ground", "chopped", "minced", "diced", "sliced", "shredded", "grated", "crushed", "whole", "large", "small", "medium",
    "thinly", "finely", "roughly", "coarsely", "plus more for serving", "for serving", "optional", "to taste", "divided", "fine", "coarse",
    "pink himalayan", "kosher", "sea", "extra virgin", "extra-virgin", "virgin", "plain", "raw", "unsalted", "salted",
]

# Names that stand for another.
NAME_ALIASES = {
    "fine pink himalayan salt": "salt",
    "fine himalayan salt": "salt",
    "kosher salt": "salt",
    "fine salt": "salt",
    "coarse salt": "salt",
    "sea salt": "salt",
    "black pepper": "pepper",
    "freshly ground pepper": "pepper",
    "freshly ground black pepper": "pepper",
    "ground black pepper": "pepper",
    "extra virgin olive oil": "olive oil",
    "extra-virgin olive oil": "olive oil",
    "feta cheese": "feta",
    "crumbled feta": "feta",
    "feta cheese, cubed or crumbled": "feta",
    "block feta cheese": "feta",
}

# Spellings of units on a shopping list.
UNIT_ALIASES = {
    "tablespoons": "tbsp", "tablespoon": "tbsp", "tbsp": "tbsp",
    "teaspoons": "tsp", "teaspoon": "tsp", "tsp": "tsp",
    "cups": "cup", "cup": "cup",
    "pounds": "lb", "pound": "lb", "lbs": "lb", "lb": "lb",
    "ounces": "oz", "ounce": "oz", "oz": "oz",
    "cloves": "clove", "clove": "clove",
    "slices": "slice", "slice": "slice",
    "cans": "can", "can": "can",
    "pieces": "piece", "piece": "piece",
}

# Tablespoons of a unit of volume, ounces of a unit of weight.
TBSP_PER_UNIT = {"tsp": 1 / 3, "tbsp": 1.0, "cup": 16.0, "fl oz": 2.0}
OZ_PER_UNIT = {"oz": 1.0, "lb": 16.0, "g": 1 / 28.35, "kg": 35.274}

# Grams of a unit, for nutrition; any other unit counts as DEFAULT_GRAMS.
GRAMS_PER_UNIT = {
    "cup": 150, "cups": 150, "tbsp": 15, "tablespoon": 15, "tablespoons": 15, "tsp": 5, "teaspoon": 5, "teaspoons": 5, "ml": 1, "fl oz": 30,
    "g": 1, "gram": 1, "grams": 1, "oz": 28, "ounce": 28, "ounces": 28, "lb": 454, "lbs": 454, "pound": 454, "pounds": 454, "kg": 1000,
    "clove": 5, "cloves": 5, "slice": 30, "slices": 30, "piece": 100, "pieces": 100, "can": 400, "bunch": 150,
}
DEFAULT_GRAMS = 50

# Nutrients as a food database names them, and the measures they become.
NUTRIENTS = {
    "Energy": "calories",
    "Protein": "protein_g",
    "Total lipid (fat)": "fat_g",
    "Carbohydrate, by difference": "carbs_g",
    "Fiber, total dietary": "fiber_g",
    "Sodium, Na": "sodium_mg",
}
MEASURES = list(NUTRIENTS.values())

# Quantity levels, fullest first, with filled segments and colours.
LEVEL_SEGMENTS = {"Full": 5, "Most": 4, "Half": 3, "Low": 2, "Almost Empty": 1}
LEVEL_COLORS = {"Full": "#27ae60", "Most": "#2e86ab", "Half": "#f39c12", "Low": "#e67e22", "Almost Empty": "#c0392b"}
OTHER_COLOR = "#999"

# Order in which storage locations are shown.
LOCATION_ORDER = ["Fridge", "Freezer", "Pantry", "Spice Rack", "Counter", "Other"]

# Badges of an observed row.
ACTION_BADGES = {"new": "NEW", "updated": "UPDATED", "unchanged": "NO CHANGE", "removed": "MISSING?"}

# Image types by file extension.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}

# Where a page's recipe card begins, where it ends, and what the whole page loses otherwise.
CARD_CLASSES = [r"wprm-recipe-container[^\"]*\"", r"wprm-recipe\b[^\"]*\"", r"tasty-recipes-entry-content[^\"]*\"", r"recipe-card-container[^\"]*\""]
CARD_ENDS = [r'<div[^>]*class="[^"]*comments', r'<div[^>]*id="comments', r'<section[^>]*class="[^"]*related', r'<div[^>]*class="[^"]*related', "</article>"]
SIDE_TAGS = ["nav", "footer", "aside"]
SIDE_CLASSES = ["comments", "related", "sidebar", "widget", "advertisement", "share"]
ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8230;", "..."),
    ("&#xBC;", "1/4"), ("&#xBD;", "1/2"), ("&#xBE;", "3/4"),
]
PAGE_TEXT_CAP, CARD_TEXT_LEAST, PAGE_TEXT_LEAST = 10_000, 200, 100

# How a page announces its picture, the property before or after the address.
PICTURE_BEFORE = r"""(?i)<meta[^>]*property=["']og:image["'][^>]*content=["']([^"']+)["']"""
PICTURE_AFTER = r"""(?i)<meta[^>]*content=["']([^"']+)["'][^>]*property=["']og:image["']"""

# Descriptors at the end of a name.
TRAILING_WORDS = r",?\s*(cubed|crumbled|halved|patted dry|cut into .*)$"

# Sections of a recorded reading, where the second ends, and from which of its characters on an end counts.
INGREDIENT_HEADER, STEP_HEADER = "INGREDIENT TRANSCRIPTION:", "AMOUNTS IN STEPS:"
STEP_LEAST = 20
STEP_ENDS = ["STEP 3:", "STEP 4:", "Cross-check", "[", "{"]
FRACTION_UNITS = ["cup", "tbsp", "tablespoon", "tsp", "teaspoon", "pound", "lb", "oz", "ounce"]


def keyword_categories() -> dict[str, str]:
    """Keyword to category; of a keyword in several categories the last counts."""
    return {word: category for category, words in CATEGORY_KEYWORDS for word in words}
