"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '[\s\p{{Z}}\x0b\x{{85}}]+', ' ', 'g'))"
IDENT = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"
BASE = "regexp_replace(" + IDENT + ", '^([A-Z]{{2}}[0-9]+)[A-Z][0-9]?$', '\\1')"
COMPONENT = "CASE WHEN lower(trim({0})) NOT IN ('', 'nan', 'none', 'null') THEN trim({0}) END"
_STRIPPED = r"regexp_replace(trim({0}), '[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?(Z|[+]00:00)?$', '')"
DATE = (
    "coalesce("
    + ", ".join(
        f"CASE WHEN regexp_full_match({_STRIPPED}, '{shape}') THEN try_strptime({_STRIPPED}, '{form}')::DATE END"
        for shape, form in (("[0-9]{{8}}", "%Y%m%d"), ("[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}", "%Y-%m-%d"), ("[0-9]{{2}} [A-Za-z]{{3}} [0-9]{{4}}", "%d %b %Y"))
    )
    + ")"
)
ITEMS = r"""list_sort(list_distinct(list_filter(list_transform(
    CASE WHEN regexp_full_match(trim(coalesce({0}, '')), '[\[({{].*[\])}}]')
         THEN string_split(regexp_replace(regexp_replace(trim({0}), '^[\[({{]', ''), '[\])}}]$', ''), ',')
         ELSE regexp_split_to_array(trim(coalesce({0}, '')), '[;,|\s]+') END,
    lambda x: trim(regexp_replace(regexp_replace(trim(x), '^[''"]', ''), '[''"]$', ''))),
    lambda x: lower(x) NOT IN ('', 'nan', 'none', 'null'))))"""
CODES = "list_sort(list_distinct(list_filter(list_transform(" + ITEMS + r""", lambda x:
    CASE WHEN regexp_matches(regexp_replace(upper(x), '[^A-Z0-9/]', '', 'g'), '^[A-HY][0-9]{{2}}[A-Z]')
         THEN substr(regexp_replace(upper(x), '[^A-Z0-9/]', '', 'g'), 1, 4) ELSE regexp_replace(upper(x), '[^A-Z0-9/]', '', 'g') END), lambda x: x <> '')))"""
REFERENCES = "list_sort(list_distinct(list_filter(list_transform(" + ITEMS + ", lambda x: " + BASE.replace("{0}", "x") + "), lambda x: x <> '')))"
TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"
#: A number on a grid of 1000 from an MD5 of parts joined by bars.
UNIFORM = "((('0x' || substr(md5({0}), 1, 8))::UBIGINT % 1000) / 1000.0::DOUBLE)"
