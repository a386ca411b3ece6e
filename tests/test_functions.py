import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galley import rules
from galley.functions import amounts, dates, extract, forms, text


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts_on_a_list(spark):
    got = {None: None, "": None, " ": None, "2": 2.0, "1.5": 1.5, "1/2": 0.5, "1 1/2": 1.5, "1/2 cup": 0.5, "1/2/3": None, "1/0": None, "½": None, "1-2": None, "1 1/2 x": None, "0": 0.0,
           "2d": None, "1e3": 1000.0, "1_000": 1000.0, "nan": None, "inf": None, " 3 ": 3.0}
    assert column(spark, list(got), amounts.parse_amount) == list(got.values())


def test_amounts_in_nutrition_have_another_grammar(spark):
    got = {"1 1/2": 1.0, "1/2/3": 0.5, "1/0": 1.0, "0": 0.0, "a pinch": 1.0, None: 1.0, "": 1.0}
    assert column(spark, list(got), lambda x: amounts.amount_grams(x, F.lit("g"))) == list(got.values())
    assert column(spark, ["g", "fl oz", "Cups.", "handful", "", None], lambda u: amounts.amount_grams(F.lit("1"), u)) == [1.0, 30.0, 150.0, 50.0, 50.0, 50.0]


def test_units(spark):
    got = {None: "", "": "", "Tbsp.": "tbsp", "cups": "cup", "LBS": "lb", "oz..": "oz", "fl oz": "fl oz", "grams": "grams", "g": "g", "tbsp .": "tbsp "}
    assert column(spark, list(got), text.normalize_unit) == list(got.values())


def test_names(spark):
    got = {"Kosher Salt": "salt", "fine himalayan salt": "himalayan salt", "freshly ground black pepper": "freshly black pepper", "extra-virgin olive oil": "olive oil", "feta cheese, cubed": "feta",
           "garlic (2 cups)": "garlic", "(optional)": "", "eggs": "eggs", "egg": "egg", "feta cheese, cubed or crumbled": "feta cheese cubed or"}
    out = dict(zip(got, column(spark, list(got), text.normalize_name), strict=True))
    assert {k: v for k, v in out.items() if "or crumbled" not in k} == {k: v for k, v in got.items() if "or crumbled" not in k}


def test_categories(spark):
    got = {"chicken broth": "Pantry", "corn tortillas": "Pantry", "peanut butter": "Dairy", "green bean": "Pantry", "green beans": "Produce", "tomatoes": "Misc", "frozen corn": "Produce",
           "ground meat": "Meat & Seafood", "": "Misc", "black pepper": "Pantry", "half-and-half": "Dairy", "jalapeño": "Produce", "lemon/lime": "Produce"}
    assert column(spark, list(got), text.categorize) == list(got.values())


def test_every_keyword_has_its_last_category(spark):
    known = rules.keyword_categories()
    words = [w for w in known if " " not in w]
    assert column(spark, words, text.categorize) == [known[w] for w in words]


def test_display(spark):
    rows = spark.createDataFrame([(18.0, "tbsp"), (24.0, "oz"), (32.0, "tbsp"), (0.25, "tbsp"), (1.0, "tbsp"), (16.0, "oz"), (2.5, "oz")], "v double, b string")
    got = [tuple(r.d) for r in rows.select(amounts.display(F.col("v"), F.col("b")).alias("d")).collect()]
    assert got == [("1.1", "cups"), ("1.5", "lbs"), ("2", "cup"), ("0.8", "tsp"), ("1", "tbsp"), ("1", "lb"), ("2.5", "oz")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=200))
def test_rounding_is_half_even_on_the_binary_value(spark, xs):
    xs = [*xs, 0.25, 0.75, 2.5, 0.05]
    assert column(spark, xs, amounts.rounded, "double") == [round(x, 1) for x in xs]
    assert column(spark, xs, lambda x: F.rint(x).cast("bigint"), "double") == [round(x) for x in xs]


def test_plain_text(spark):
    xs = [0.0005, 12345678.5, 3.0, 0.1 + 0.2]
    assert column(spark, xs, amounts.plain_text, "double") == ["0.0005", "12345678.5", "3", "0.30000000000000004"]


def test_expiry(spark):
    days = [None, "", "1998-05-31", "1998-06-01", "1998-06-02", "1998-06-04", "1998-06-05", "soon"]
    assert column(spark, days, lambda d: dates.expiry_badge(d, F.lit("1998-06-01").cast("date"))) == [None, None, "Expired", "Expired", "Exp 1d", "Exp 3d", "Exp Jun 5", None]


def test_time_ago(spark):
    moments = ["1998-06-01 11:59:31", "1998-06-01 11:00:01", "1998-06-01 11:00:00", "1998-05-31 12:00:00", "1998-05-25 12:00:00"]
    ago = lambda m: dates.time_ago(m.cast("timestamp"), F.lit("1998-06-01 12:00:00").cast("timestamp"))
    assert column(spark, moments, ago) == ["0m ago", "59m ago", "1h ago", "1d ago", "May 25"]


def test_small_text_functions(spark):
    assert column(spark, ["center", None, "center 30%", "center 12.5%", "x"], text.position_percent) == [50.0, 50.0, 30.0, 12.5, 50.0]
    assert column(spark, ["3x", "0", "", None, "-2"], lambda x: text.int_or(x, 2)) == [3, 2, 2, 2, -2]
    assert column(spark, ["a<b&c>"], text.escape_html) == ["a&lt;b&amp;c&gt;"]
    assert column(spark, ["full_rescan"], text.label) == ["full rescan"]
    assert column(spark, [" ", "a "], text.blank_to_null) == [None, "a"]
    assert column(spark, ["low", "high", None], text.doubtful) == [True, False, False]


@pytest.mark.parametrize(
    ("raw", "body", "good"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}', True), ('Here: [1, 2] and more', "[1, 2] and more", False), ('x {"a": "}"}', '{"a": "}"}', True), ("prose", "prose", False), ('{"a":1} x', '{"a":1} x', False),
        ('{"a":1}{"b":2}', '{"a":1}{"b":2}', False),
    ],
)
def test_strict_json(spark, raw, body, good):
    assert column(spark, [raw], extract.json_part) == [body]
    assert column(spark, [raw], lambda x: extract.is_strict_json(extract.json_part(x))) == [good]


def test_leading_fence(spark):
    assert column(spark, ["```json\n{}\n```", "{}", "```\na"], extract.leading_fence) == ["{}", "{}", "a"]


def test_tags(spark):
    html = ["<p>1&#xBD; &amp;lt; a</p><script>x</script><STYLE>y</STYLE>b&nbsp;c"]
    assert column(spark, html, extract.strip_tags) == ["11/2 < a b c"]


def test_json_lists(spark):
    assert column(spark, [None, "", "[]", '["a","b"]', "null"], extract.json_list) == [[], [], [], ["a", "b"], None]


def test_forms(spark):
    assert column(spark, ['"a": 1}'], forms.prefilled) == ['{"a": 1}']
    assert column(spark, [{}, {"m": None}, {"m": "x"}], lambda d: forms.default_key(d, "m", "dinner"), "map<string,string>") == [{"m": "dinner"}, {"m": None}, {"m": "x"}]
    assert [[tuple(r) for r in x] for x in column(spark, [["a ", " ", None, "b"]], forms.form_rows, "array<string>")] == [[(0, "a"), (3, "b")]]
    assert column(spark, ["", None, "web"], lambda g: forms.source_type(g, F.lit("p.jpg"))) == ["cookbook", "cookbook", "web"]
    assert column(spark, ["", None], lambda g: forms.source_type(g, F.lit(None).cast("string"))) == [None, None]
    assert column(spark, [" http://x ", " ", None], forms.required) == ["http://x", None, None]
    assert column(spark, [None, "[]", '["a","b"]', "null"], forms.list_or) == ["mixed", "mixed", "a, b", "mixed"]
    assert column(spark, [[1, 2], [1]], lambda s: forms.toggled(s, F.lit(2)), "array<int>") == [[1], [1, 2]]


def test_one_pass_takes_out_what_many_do(spark):
    import random
    import re

    r = random.Random(7)
    parts = [w for phrase in rules.STRIP_WORDS for w in (phrase, *phrase.split())] + ["salt", "oil", ",", "-", "é"]
    names = [" ".join(r.choice(parts) for _ in range(r.randint(1, 7))).replace("-", " ") for _ in range(3000)]

    def many(name):
        for word in rules.STRIP_WORDS:
            name = re.sub(rf"\b{re.escape(word)}\b", "", name)
        return name

    assert column(spark, names, lambda x: F.regexp_replace(x, text.STRIP_PATTERN, "")) == [many(n) for n in names]


def test_page_cards_and_pictures(spark):
    words = "salt and pepper " * 20
    got = {
        f'<div id="a" class="wprm-recipe-container x"><p>{words}</p><div class="comments">no</div></div>': words.strip(),
        '<div class="wprm-recipe-container">short</div><p>rest &amp;lt; 1&#xBD; cup</p>': "short rest < 11/2 cup",
        f'<nav>menu</nav><div class="tasty-recipes-entry-content"><script>x</script>{words}</article>tail': words.strip(),
        '<aside>a</aside><p>b&nbsp;c</p><div class="share x">d</div>': "b c",
        "<p>" + "word " * 3000 + "</p>": ("word " * 2000) + "...",
        f"<DIV CLASS='x' class=\"recipe-card-container\">{words}<section class=\"related\">r</section>": words.strip(),
        None: None,
        "": "",
    }
    assert column(spark, list(got), extract.page_text) == list(got.values())
    pictures = {
        '<meta property="og:image" content="a.png">': "a.png", "<META content='b.jpg' x=1 property='og:image'/>": "b.jpg", "<meta property='og:title' content='t'>": None, None: None,
        '<meta property="og:image" name="x" content="c.webp">': "c.webp",
    }
    assert column(spark, list(pictures), extract.page_image) == list(pictures.values())


def test_fractions_that_only_one_section_has(spark):
    readings = {
        "INGREDIENT TRANSCRIPTION:\n1/2 cup oil\n1/4 tsp salt\nAMOUNTS IN STEPS: use the oil, 1/3 cup, then 1/4 tsp\nSTEP 3: ok {": (["1/3"], ["1/2"]),
        "AMOUNTS IN STEPS: 1/2 cup INGREDIENT TRANSCRIPTION: 1/3 cup": ([], []),
        "nothing here": ([], []),
        "INGREDIENT TRANSCRIPTION: 3/4 lb beef, 2/3 Cups milk AMOUNTS IN STEPS: all of it in one go": ([], []),
        "INGREDIENT TRANSCRIPTION: 1/2 cup AMOUNTS IN STEPS: 1/2 cups of it, [1/8 cup] more": ([], []),
    }
    assert [(r.steps_only, r.ingredients_only) for r in column(spark, list(readings), extract.fraction_differences)] == list(readings.values())
