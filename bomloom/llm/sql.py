"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_GAP = r"\s\pZ\pP\pS"


def _plain(x: str) -> str:
    """Lower case without blanks and punctuation, which stays between digits (marked by \\x04 meanwhile)."""
    lowered = f"lower({x})"
    no_blanks = rf"regexp_replace({lowered}, '[\s\pZ]+', '', 'g')"
    # mark punctuation runs between digits; twice, as neighbouring runs share a digit
    marked = no_blanks
    for _ in range(2):
        marked = rf"regexp_replace({marked}, '(\p{{Nd}})([\pP\pS]+)(\p{{Nd}})', '\1' || chr(4) || '\2' || chr(4) || '\3', 'g')"
    # outside of marks, drop punctuation: split at the marks, odd pieces are content
    return rf"array_to_string(list_transform(string_split({marked}, chr(4)), lambda p, i: CASE WHEN i % 2 = 0 THEN p ELSE regexp_replace(p, '[\pP\pS]+', '', 'g') END), '')"


def _decoded(x: str) -> str:
    return f"url_decode({x})"


def _text(x: str) -> str:
    return f"coalesce('v' || {_plain(_decoded(x))}, 'n')"


_PURL = f"""coalesce('v' || CASE WHEN contains({_decoded('purl')}, '?') THEN {_plain(f"split_part({_decoded('purl')}, '?', 1)")} || chr(1) ||
  array_to_string(list_sort(list_filter(list_transform(string_split(split_part({_decoded('purl')}, '?', 2), '&'), lambda q: {_plain('q')}), lambda q: q <> '')), chr(2))
  ELSE {_plain(_decoded('purl'))} || chr(1) END, 'n')"""
_LICENCES = f"""CASE WHEN licenses IS NULL THEN 'n' ELSE 'v' || array_to_string(list_sort(list_transform(licenses, lambda l:
  {_text('l.license.id')} || chr(3) || {_text('l.license.name')} || chr(3) || {_text('l.expression')})), chr(2)) END"""
_PROPERTIES = f"'v' || array_to_string(list_sort(list_transform(properties, lambda l: {_text('l.name')} || chr(3) || {_text('l.value')})), chr(2))"
_KEYED = f"""WITH keyed AS (SELECT comp_id, concat_ws(chr(31), {_text('bom_serial')}, {_text('comp_type')}, {_text('name')}, {_text('version')}, {_PURL}, {_LICENCES}, {_PROPERTIES}) AS k FROM cdx_components),
runs AS (SELECT comp_id, min(comp_id) OVER (PARTITION BY k) AS keep_id FROM keyed)"""

SQL = {
    "p2_found": f"{_KEYED} SELECT keep_id, comp_id FROM runs WHERE comp_id <> keep_id",
    "p2_records": f"{_KEYED} SELECT keep_id, count(*) AS n_copies FROM runs GROUP BY keep_id",
}
