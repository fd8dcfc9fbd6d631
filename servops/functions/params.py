"""Generation-parameter handling.

Parameters are ``map<string,string>`` whose values are JSON literals
(``0.7``, ``1024``, ``"END"``), so that the merged map serialises exactly like
``json.dumps`` of the Python dict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request defaults every generation starts from, in this order.
DEFAULT_PARAMS = [("temperature", "0.7"), ("max_tokens", "1024"), ("top_p", "0.95")]


def default_params() -> Column:
    args = []
    for k, v in DEFAULT_PARAMS:
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def merge_params(defaults: Column, overrides: Column) -> Column:
    """``d = defaults.copy(); d.update(overrides)`` keeping dict key order.

    ``map_concat`` raises on duplicate keys, so defaults are overridden in
    place and only new keys are appended.
    """
    ov = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    kept = F.transform_values(defaults, lambda k, v: F.coalesce(F.element_at(ov, k), v))
    new = F.map_filter(ov, lambda k, v: ~F.array_contains(F.map_keys(defaults), k))
    return F.map_concat(kept, new)


def params_json(m: Column) -> Column:
    """``json.dumps`` formatting (``{"k": v, ...}``) of a map of JSON literals."""
    entries = F.transform(F.map_entries(m),
                          lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
