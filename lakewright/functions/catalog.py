"""Fixed lookup values."""

from __future__ import annotations

# Identifiers of engines and lake formats.
ENGINES = {"spark": 0, "presto": 1, "trino": 2}
LAKES = {"delta": 0, "iceberg": 1, "hudi": 2}

# Benchmarks pooled by default, and the sweep of (benchmark, scale factor).
BENCHMARKS = ["tpcds", "ssb", "ssb_flat", "job", "tpch"]
SWEEP = [
    ("tpcds", "100"), ("tpch", "100"), ("ssb", "100"), ("ssb_flat", "100"),
    ("tpcds", "10"), ("tpch", "10"), ("ssb", "10"), ("ssb_flat", "10"), ("job", "10"),
    ("tpcds", "1"), ("tpch", "1"), ("ssb", "1"), ("ssb_flat", "1"),
]

FLOOR_MS = 1500.0
RATIO_CAP = 20.0
SAMPLE_LIMIT = 16
MATCH_SHARE = 0.1

# Column prefix to table, per benchmark.
PREFIX_TABLES = {
    "tpch": {
        "c": "customer", "l": "lineitem", "n": "nation", "o": "orders", "p": "part",
        "ps": "partsupp", "r": "region", "s": "supplier", "d": "date",
    },
    "ssb": {"s": "supplier", "lo": "lineorder", "c": "customer", "p": "part", "d": "date"},
    "tpcds": {
        "ca": "customer_address", "cc": "call_center", "cd": "customer_demographics",
        "cp": "catalog_page", "cr": "catalog_returns", "cs": "catalog_sales", "c": "customer",
        "d": "date_dim", "hd": "household_demographics", "i": "item", "ib": "income_band",
        "inv": "inventory", "p": "promotion", "r": "reason", "sm": "ship_mode", "s": "store",
        "sr": "store_returns", "ss": "store_sales", "t": "time_dim", "w": "warehouse",
        "web": "web_site", "wp": "web_page", "wr": "web_returns", "ws": "web_sales",
    },
    "job": {
        "s": "supplier", "lo": "lineorder", "c": "customer", "p": "part", "d": "date",
        "an": "aka_name", "at": "aka_title", "ci": "cast_info", "chn": "char_name",
        "cn": "company_name", "ct": "company_type", "cct": "comp_cast_type",
        "cc": "complete_cast", "it": "info_type", "kw": "keyword", "kt": "kind_type",
        "lt": "link_type", "mc": "movie_companies", "mi": "movie_info",
        "mii": "movie_info_idx", "mk": "movie_keyword", "ml": "movie_link", "nm": "name",
        "pi": "person_info", "rt": "role_type", "tl": "title",
    },
}
