"""Expressions of the scalar functions in DuckDB's SQL, for the oracle queries."""

from __future__ import annotations

from galley import rules

NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(key: str, table: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else repr(v)}" for k, v in table.items()) + f" ELSE {other} END"


def cleaned_name(x: str) -> str:
    """normalize_name up to the aliases."""
    x = rf"regexp_replace(replace(lower(trim({x})), '-', ' '), '\([^)]*\)', '', 'g')"
    for word in rules.STRIP_WORDS:
        x = rf"regexp_replace({x}, '\b{word.replace('-', '[-]')}\b', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '[,;]+', '', 'g'), '\s+', ' ', 'g'))"


def names(source: str, column: str = "name") -> str:
    """SELECT *, norm: the source's rows with the normalized name."""
    one = f"SELECT *, {cleaned_name(column)} AS n0 FROM {source}"
    two = f"SELECT *, {cases('n0', rules.NAME_ALIASES, 'n0')} AS n1 FROM ({one})"
    three = rf"SELECT *, trim(regexp_replace(n1, '{rules.TRAILING_WORDS}', '')) AS n2 FROM ({two})"
    return f"SELECT * EXCLUDE (n0, n1, n2), {cases('n2', rules.NAME_ALIASES, 'n1')} AS norm FROM ({three})"


def unit(x: str) -> str:
    bare = rf"regexp_replace(trim(lower(coalesce({x}, ''))), '\.+$', '')"
    return cases(bare, rules.UNIT_ALIASES, bare)


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), {quote(NUMBER)}) THEN try_cast(replace(trim({x}), '_', '') AS DOUBLE) END"


def ratio(x: str) -> str:
    a, b = number(f"split_part({x}, '/', 1)"), number(f"split_part({x}, '/', 2)")
    return f"CASE WHEN len(string_split({x}, '/')) = 2 THEN {a} / nullif({b}, 0) END"


def amount(x: str) -> str:
    words = rf"regexp_split_to_array(trim({x}), '\s+')"
    first, second = f"{words}[1]", f"{words}[2]"
    return (
        f"CASE WHEN contains(trim({x}), '/') THEN CASE WHEN len({words}) = 2 AND contains({second}, '/') THEN {number(first)} + {ratio(second)} "
        f"WHEN contains({first}, '/') THEN {ratio(first)} END ELSE {number(x)} END"
    )


def grams(amount_: str, unit_: str) -> str:
    value = f"CASE WHEN contains({amount_}, '/') THEN {number(f'''split_part({amount_}, '/', 1)''')} / nullif({number(f'''split_part({amount_}, '/', 2)''')}, 0) ELSE {number(amount_)} END"
    bare = rf"regexp_replace(trim(lower({unit_})), '\.+$', '')"
    return f"coalesce({value}, 1.0) * {cases(bare, rules.GRAMS_PER_UNIT, str(rules.DEFAULT_GRAMS))}"


def base_factor(u: str) -> str:
    return cases(u, rules.TBSP_PER_UNIT | rules.OZ_PER_UNIT, "NULL")


def base_unit(u: str) -> str:
    return cases(u, dict.fromkeys(rules.TBSP_PER_UNIT, "tbsp") | dict.fromkeys(rules.OZ_PER_UNIT, "oz"), "NULL")


def _shown(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {x}) END"


def display_amount(v: str, b: str) -> str:
    return f"CASE WHEN {v} >= 16 THEN {_shown(f'({v} / 16)')} WHEN {b} = 'tbsp' AND {v} < 1 THEN {_shown(f'({v} * 3)')} ELSE {_shown(v)} END"


def display_unit(v: str, b: str) -> str:
    return (
        f"CASE WHEN {b} = 'tbsp' THEN CASE WHEN {v} >= 16 THEN CASE WHEN {v} / 16 = floor({v} / 16) THEN 'cup' ELSE 'cups' END WHEN {v} >= 1 THEN 'tbsp' ELSE 'tsp' END "
        f"ELSE CASE WHEN {v} >= 16 THEN CASE WHEN {v} / 16 = floor({v} / 16) THEN 'lb' ELSE 'lbs' END ELSE 'oz' END END"
    )


def category(x: str) -> str:
    """Of a name: the last word that is a keyword, else a phrase in it, else Misc."""
    known = rules.keyword_categories()
    clean = rf"regexp_replace(regexp_replace(lower({x}), '\([^)]*\)', '', 'g'), '[,;/]+', ' ', 'g')"
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known.items()) + "}"
    words = rf"list_reverse(regexp_split_to_array(trim({clean}), '\s+'))"
    by_word = rf"list_filter(list_transform({words}, lambda w: {table}[regexp_replace(w, '^\.+|\.+$', '', 'g')]), lambda c: c IS NOT NULL)[1]"
    phrases = " ".join(f"WHEN contains({clean}, {quote(k)}) THEN {quote(v)}" for k, v in known.items() if " " in k)
    return f"coalesce({by_word}, CASE {phrases} END, 'Misc')"


def stripped_tags(x: str) -> str:
    x = f"regexp_replace({x}, '<script[^>]*>.*?</script>', '', 'gis')"
    x = f"regexp_replace({x}, '<style[^>]*>.*?</style>', '', 'gis')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, plain in rules.ENTITIES:
        x = f"replace({x}, {quote(entity)}, {quote(plain)})"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def page_text(x: str) -> str:
    for tag in rules.SIDE_TAGS:
        x = f"regexp_replace({x}, '<{tag}[^>]*>.*?</{tag}>', '', 'gis')"
    for name in rules.SIDE_CLASSES:
        x = f"""regexp_replace({x}, '<div[^>]*class="[^"]*{name}[^"]*"[^>]*>.*?</div>', '', 'gis')"""
    return stripped_tags(x)
