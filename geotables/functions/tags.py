"""Reading values out of the JSON ``tags`` column."""

from __future__ import annotations


def tag_sql(tags: str, name: str) -> str:
    """Value of one tag as a string: lenient like a permissive JSON reader (unquoted names allowed), numbers kept as
    written, nested objects returned as JSON text. Missing tag or broken JSON gives NULL instead of failing."""
    name = name.replace("\\", "\\\\").replace("'", "\\'")
    return (f"try_element_at(from_json({tags}, 'map<string,string>', "
            f"map('allowUnquotedFieldNames', 'true', 'allowSingleQuotes', 'true')), '{name}')")
