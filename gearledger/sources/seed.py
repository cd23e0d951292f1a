"""Small literal tables for unit tests: one shop, ten customers, 22 equipments and their stock.

The rows carry the values that decide results (prices, dates, mounts, coordinates, stock);
names and other texts are made up from the row number.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .schemas import schema

CREATED = dt.datetime(2024, 1, 1)

# Latitude and longitude of shop S0001 and of customers C0001 to C0010.
SHOP = ("10.817", "106.652")
CUSTOMERS = (
    ("10.776889", "106.700806"), ("10.787272", "106.749810"), ("10.782909", "106.695227"),
    ("10.757451", "106.701721"), ("10.754027", "106.663374"), ("10.748092", "106.635236"),
    ("10.728073", "106.721334"), ("10.724000", "106.628000"), ("10.810583", "106.709142"),
    ("10.849000", "106.771000"),
)
INACTIVE_CUSTOMERS = (3, 6, 10)
ROLES = ("ADMIN", "STAFF", "MANAGER", "SUPPORT", "SALES")
INACTIVE_EMPLOYEES = (4,)
CATEGORIES = ("Camera", "Lens", "Lighting", "Tripod", "Audio", "Accessories")

# Price, price per day, purchase date, mount, yearly depreciation, deposit share,
# high-value flag, total and available stock of EQ001 to EQ022; four rows per category, two in the last.
EQUIPMENTS = (
    (60000000, 500000, "2022-01-01", "RF", "0.10", "0.30", 1, 2, 1),
    (55000000, 450000, "2021-06-15", "E", "0.10", "0.30", 1, 2, 2),
    (50000000, 400000, "2022-03-10", "Z", "0.10", "0.30", 1, 1, 1),
    (38000000, 300000, "2021-11-20", "X", "0.12", "0.25", 0, 1, 1),
    (25000000, 200000, "2022-02-01", "RF", "0.10", "0.20", 0, 2, 1),
    (22000000, 180000, "2021-09-01", "E", "0.10", "0.20", 0, 2, 2),
    (20000000, 150000, "2022-05-01", "Z", "0.10", "0.20", 0, 1, 1),
    (21000000, 170000, "2021-08-10", "EF", "0.10", "0.20", 0, 1, 1),
    (7000000, 50000, "2021-07-01", None, "0.15", "0.10", 0, 2, 2),
    (6000000, 40000, "2022-01-10", None, "0.15", "0.10", 0, 2, 1),
    (10000000, 80000, "2021-12-01", None, "0.15", "0.10", 0, 1, 1),
    (8000000, 60000, "2022-04-01", None, "0.15", "0.10", 0, 1, 1),
    (5000000, 30000, "2021-06-01", None, "0.15", "0.10", 0, 2, 1),
    (4000000, 25000, "2021-09-01", None, "0.15", "0.10", 0, 1, 1),
    (3500000, 20000, "2022-01-01", None, "0.15", "0.10", 0, 1, 1),
    (9000000, 70000, "2022-02-01", None, "0.15", "0.10", 0, 1, 1),
    (3000000, 20000, "2021-05-01", None, "0.15", "0.10", 0, 2, 1),
    (3500000, 25000, "2021-08-01", None, "0.15", "0.10", 0, 1, 1),
    (7000000, 50000, "2022-03-01", None, "0.15", "0.10", 0, 1, 1),
    (800000, 10000, "2021-04-01", None, "0.15", "0.10", 0, 2, 2),
    (1500000, 0, "2022-01-01", None, "0.20", "0.00", 0, 3, 3),
    (300000, 0, "2022-01-01", None, "0.20", "0.00", 0, 3, 3),
)

# Tax id, name, percent, active, first and last day.
TAXES = (
    ("T0001", "VAT 10%", "10", 1, "2024-01-01", "2099-12-31"),
    ("T0002", "VAT 8%", "8", 1, "2023-01-01", "2023-12-31"),
    ("T0003", "VAT 5%", "5", 0, "2022-01-01", "2022-12-31"),
)


def _day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def _equipment_rows() -> list[tuple]:
    rows = []
    for n, (price, per_day, bought, mount, rate, deposit, high_value, *_stock) in enumerate(EQUIPMENTS, start=1):
        category = (n - 1) // 4
        rows.append((
            f"EQ{n:03d}", f"{CATEGORIES[category]} {n:02d}",
            "ACCESSORY" if category == 5 else "MAIN", "AVAILABLE", None, Decimal(price),
            Decimal(price), Decimal(per_day), Decimal(rate), 0, _day(bought), None, None, mount,
            f"CAT{category + 1:02d}", high_value, Decimal(deposit), CREATED,
        ))
    return rows


def seed_rows() -> dict[str, list[tuple]]:
    return {
        "shop_info": [
            ("S0001", "Main shop", "Street 1", "HCM", "Hoc Mon", CREATED, *map(Decimal, SHOP))
        ],
        "customers": [
            (f"C{n:04d}", f"user{n:02d}", f"hash{n:02d}", f"Customer {n:02d}",
             f"user{n:02d}@example.com", f"09{n:08d}", f"Street {n}",
             "INACTIVE" if n in INACTIVE_CUSTOMERS else "ACTIVE", CREATED, *map(Decimal, place))
            for n, place in enumerate(CUSTOMERS, start=1)
        ],
        "employees": [
            (f"E{n:04d}", f"emp{n:02d}", f"hash{n:02d}", f"Employee {n:02d}",
             f"emp{n:02d}@example.com", f"091{n:07d}", role,
             "INACTIVE" if n in INACTIVE_EMPLOYEES else "ACTIVE", CREATED)
            for n, role in enumerate(ROLES, start=1)
        ],
        "categories": [
            (f"CAT{n:02d}", name, f"{name} equipment", CREATED)
            for n, name in enumerate(CATEGORIES, start=1)
        ],
        "equipments": _equipment_rows(),
        "taxes": [
            (tax, name, name, Decimal(rate), active, _day(start), _day(end), CREATED, CREATED)
            for tax, name, rate, active, start, end in TAXES
        ],
        "inventory": [
            (f"IV{n:03d}", total, free, total - free, 0, 0, 0, CREATED, f"EQ{n:03d}")
            for n, (*_rest, total, free) in enumerate(EQUIPMENTS, start=1)
        ],
    }


def seed_table(spark: SparkSession, table: str) -> DataFrame:
    """A seed table with its declared schema."""
    return spark.createDataFrame(seed_rows()[table], schema(table, "string"))
