"""Get JSON out of free-form model replies, repairing it only when needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusql.functions.binding import let
from corpusql.functions.text import strip

# Repair steps, in order. They touch a reply only after strict parsing failed.
_REPAIRS = (
    (r"(?s)/\*.*?\*/", ""),  # block comments
    (r"(?m)(^|[\s,{\[}\]])//[^\n]*", "$1"),  # line comments, never inside a URL
    (r"\}(\s*)\{", "},$1{"),  # missing comma between objects
    (r"\](\s*)\[", "],$1["),  # missing comma between lists
    (r"\"(\s*\n\s*)\"", "\",$1\""),  # missing comma at a line end
    (r",(\s*[}\]])", "$1"),  # trailing comma
    (r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)", "$1\"$2\"$3"),  # bare key
)


def strip_fences(reply: Column) -> Column:
    def opened(text: Column) -> Column:
        return strip(F.when(text.startswith("```"), F.regexp_replace(text, r"\A```(?:json)?", "")).otherwise(text))

    def closed(text: Column) -> Column:
        return F.when(text.endswith("```"), F.regexp_replace(text, r"```\z", "")).otherwise(text)

    return strip(let(strip(reply), lambda text: F.when(text.contains("```"), closed(opened(text))).otherwise(text)))


def slice_json(body: Column) -> Column:
    """The list of objects that encloses everything, else the outermost object, else a list."""
    objects = F.regexp_extract(body, r"(?s)\A[^{\[]*(\[\s*\{.*\}[\s,]*\])[^}\]]*\z", 1)
    obj = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    return (
        F.when(objects != "", objects)
        .when(obj != "", obj)
        .when(array != "", array)
        .otherwise(body)
    )


def is_json(text: Column) -> Column:
    """Strict check. The brackets make the parser reject anything after the value."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    return F.try_parse_json(wrapped).isNotNull() & (strip(text) != "")


def _one_value(text: Column) -> Column:
    """A bare run of objects (``{...},{...}``) as a list."""
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    run = text.startswith("{") & text.rlike(r"\}\s*,\s*\{")
    many = run & (F.size(F.from_json(wrapped, "array<string>")) > 1)
    return F.when(many, wrapped).otherwise(text)


def repair(text: Column) -> Column:
    # Single quotes become double quotes only if the reply uses no double quote.
    fixed = F.when(text.contains('"'), text).otherwise(F.translate(text, "'", '"'))
    for pattern, replacement in _REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, replacement)
    return fixed


def salvage(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)(\"entities\"\s*:\s*\[.*?\])", 1)
    return F.when(found != "", F.concat(F.lit("{"), found, F.lit("}")))


def parse_reply(reply: Column) -> Column:
    """Struct(json, repair_level).

    Level 0: clean or fenced. 1: cut out of surrounding chatter. 2: repaired.
    3: only the list of entities could be saved. NULL: not JSON.
    """
    return let(strip_fences(reply), parse_body)


def parse_body(body: Column) -> Column:
    """The same for a reply without fences. ``body`` should be a column: it is named several times."""
    none = F.struct(
        F.lit(None).cast("string").alias("json"), F.lit(None).cast("int").alias("repair_level")
    )

    def level(n: int, text: Column) -> Column:
        return F.struct(_one_value(text).alias("json"), F.lit(n).alias("repair_level"))

    # Each step is inside the ``otherwise`` of the one before: a clean reply is
    # parsed once and never reaches the cutting and repairing patterns.
    def saved(cut: Column) -> Column:
        return let(salvage(cut), lambda s: F.when(is_json(s), level(3, s)).otherwise(none))

    def repaired(cut: Column) -> Column:
        return let(
            repair(cut), lambda fixed: F.when(is_json(fixed), level(2, fixed)).otherwise(saved(cut))
        )

    def cut_out(body: Column) -> Column:
        return let(
            slice_json(body),
            lambda cut: F.when(is_json(cut), level(1, cut)).otherwise(repaired(cut)),
        )

    return F.when(is_json(body), level(0, body)).otherwise(cut_out(body))


ENTITY_FIELDS = "struct<attributes:map<string,string>,confidence:double,source_text:string>"


def entity_list(json_text: Column) -> Column:
    """Entities of a reply: from {"entities": [...]}, a list, or a bare run of objects."""
    named = F.from_json(json_text, f"struct<entities:array<{ENTITY_FIELDS}>>")["entities"]
    listed = F.from_json(
        F.when(json_text.startswith("["), json_text).otherwise(
            F.concat(F.lit("["), json_text, F.lit("]"))
        ),
        f"array<{ENTITY_FIELDS}>",
    )
    bare = F.filter(listed, lambda e: e["attributes"].isNotNull())
    return F.coalesce(named, bare)
