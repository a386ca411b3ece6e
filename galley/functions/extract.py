"""Text out of pages and recorded readings, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import rules

from .text import bind, strip

FRACTION = r"(?i)(\d+/\d+)\s*(?:" + "|".join(rules.FRACTION_UNITS) + ")"


def strip_tags(html: Column) -> Column:
    """Visible text: scripts and styles out, tags to spaces, some references decoded one after the other, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", "")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, plain in rules.ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def card_text(html: Column) -> Column:
    """The text of the first kind of recipe card that has more than the least number of characters, or null."""
    branches = []
    for name in rules.CARD_CLASSES:
        at = F.regexp_instr(html, F.lit(rf'(?i)<div[^>]*class="[^"]*{name}'))

        def from_card(start: Column) -> Column:
            chunk = F.when(start > 0, F.substring(html, start, F.length(html)))
            ends = lambda c: F.least(*[F.nullif(F.regexp_instr(c, F.lit(f"(?i){e}")), F.lit(0)) for e in rules.CARD_ENDS])
            cut = bind(chunk, lambda c: bind(ends(c), lambda e: F.when(e.isNull(), c).otherwise(F.substring(c, F.lit(1), e - 1))))
            return bind(strip_tags(cut), lambda t: F.when(F.length(t) > rules.CARD_TEXT_LEAST, F.substring(t, 1, rules.PAGE_TEXT_CAP)))

        branches.append(bind(at, from_card))
    return F.coalesce(*branches)


def whole_page_text(html: Column) -> Column:
    """The page's text without side parts; a text over the cap is cut and ends in dots."""
    x = html
    for tag in rules.SIDE_TAGS:
        x = F.regexp_replace(x, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    for name in rules.SIDE_CLASSES:
        x = F.regexp_replace(x, rf'(?is)<div[^>]*class="[^"]*{name}[^"]*"[^>]*>.*?</div>', "")
    cap = rules.PAGE_TEXT_CAP
    return bind(strip_tags(x), lambda t: F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("..."))).otherwise(t))


def page_text(html: Column) -> Column:
    """Text of the recipe card, or else of the page."""
    return F.coalesce(card_text(html), whole_page_text(html))


def page_image(html: Column) -> Column:
    """The page's picture as it is announced for sharing, or null."""
    before = F.regexp_extract(html, rules.PICTURE_BEFORE, 1)
    after = F.regexp_extract(html, rules.PICTURE_AFTER, 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit("")))


def image_suffix(content_type: Column) -> Column:
    return F.when(F.contains(content_type, F.lit("png")), ".png").when(F.contains(content_type, F.lit("webp")), ".webp").otherwise(".jpg")


def media_type(filename: Column) -> Column:
    """The type of a picture by its file's extension; jpeg for any other."""
    out = F.lit("image/jpeg")
    for suffix, kind in rules.MEDIA_TYPES.items():
        out = F.when(F.lower(filename).endswith(suffix), kind).otherwise(out)
    return out


def json_part(response: Column) -> Column:
    """The JSON in a reply: what a code fence holds, or else everything from the first bracket on."""

    def of(text: Column) -> Column:
        fence = F.regexp_extract(text, r"```(?:json)?\s*\n([\s\S]*?)```", 1)
        fenced = text.rlike(r"```(?:json)?\s*\n[\s\S]*?```")
        at = F.least(F.nullif(F.locate("[", text), F.lit(0)), F.nullif(F.locate("{", text), F.lit(0)))
        return F.when(fenced, strip(fence)).when(at.isNotNull(), F.substring(text, at, F.length(text))).otherwise(text)

    return bind(strip(response), of)


def leading_fence(response: Column) -> Column:
    """A reply without a fence that opens it: its first line, and a last line that closes it."""

    def of(text: Column) -> Column:
        lines = F.split(text, "\n")
        body = F.when(strip(F.element_at(lines, -1)) == "```", F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(F.slice(lines, F.lit(2), F.size(lines)))
        return F.when(text.startswith("```"), F.array_join(body, "\n")).otherwise(text)

    return bind(strip(response), of)


def is_strict_json(text: Column) -> Column:
    """Whether a text is one JSON object or array and nothing after it."""
    closed = ((text.startswith("{")) & F.rtrim(text).endswith("}")) | ((text.startswith("[")) & F.rtrim(text).endswith("]"))
    return F.coalesce(closed & F.try_parse_json(text).isNotNull() & ~_trailing(text), F.lit(False))


def _trailing(text: Column) -> Column:
    """Whether brackets outside strings close before the end."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    signs = F.filter(F.split(bare, ""), lambda c: c.isin("{", "[", "}", "]"))
    depth = lambda s, c: F.when(s < 0, s).when(c.isin("{", "["), F.abs(s) + 1).when(s == 1, F.lit(-1)).otherwise(s - 1)
    # -1: closed; any bracket after that makes it -2
    ended = F.aggregate(signs, F.lit(0), lambda s, c: F.when(s == -1, F.lit(-2)).otherwise(depth(s, c)))
    return (ended != -1) | ~F.regexp_replace(strip(bare), r"(?s)^.*[}\]]", "").eqNullSafe(F.lit(""))


def json_list(text: Column) -> Column:
    """A JSON text as an array of strings; null and "" are empty."""
    return F.from_json(F.coalesce(F.nullif(text, F.lit("")), F.lit("[]")), "array<string>")


def reading_sections(response: Column) -> Column:
    """struct(ingredients, steps): the two sections of a reading, "" unless both headers are there."""
    first, second = F.locate(rules.INGREDIENT_HEADER, response), F.locate(rules.STEP_HEADER, response)
    both = (first > 0) & (second > 0)

    def end(start: Column) -> Column:
        tail = F.substring(response, start + rules.STEP_LEAST, F.length(response))
        at = F.least(*[F.nullif(F.locate(m, tail), F.lit(0)) for m in rules.STEP_ENDS])
        return F.coalesce(at + rules.STEP_LEAST - 1, F.length(response) - start + 1)

    ingredients = F.when(both & (second > first), F.substring(response, first, second - first)).otherwise("")
    steps = F.when(both, F.substring(response, second, end(second))).otherwise("")
    return F.struct(ingredients.alias("ingredients"), steps.alias("steps"))


def fractions(text: Column) -> Column:
    """All fractions before a unit, in order."""
    return F.regexp_extract_all(text, F.lit(FRACTION), 1)


def fraction_differences(response: Column) -> Column:
    """struct(steps_only, ingredients_only): distinct fractions that one section has and the other not, sorted; the second only if the steps have any."""
    none = F.array().cast("array<string>")

    def of(s: Column) -> Column:
        a, b = fractions(s["ingredients"]), fractions(s["steps"])
        some = (s["ingredients"] != "") & (s["steps"] != "")
        return F.struct(
            F.when(some, F.array_sort(F.array_except(b, a))).otherwise(none).alias("steps_only"),
            F.when(some & (F.size(b) > 0), F.array_sort(F.array_except(a, b))).otherwise(none).alias("ingredients_only"),
        )

    return bind(reading_sections(response), of)
