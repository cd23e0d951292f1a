"""Schemas, keys, checks and defaults of the eighteen rental tables, as data.

A column reads ``name type``; ``!`` marks NOT NULL. ``id`` columns are text in the seed rows
and whole numbers in the mapped driver tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

# The data model.
TABLES: dict[str, str] = {
    "shop_info": """shop_id id!, shop_name string!, shop_address string!, city string!,
        district string!, created_at ts!, latitude coord, longitude coord""",
    "customers": """customer_id id!, username string!, password_hash string!, full_name string!,
        email string!, phone string!, address string!, status string!, created_at ts!,
        latitude coord, longitude coord""",
    "employees": """employee_id id!, username string!, password_hash string!, full_name string!,
        email string!, phone string!, role string!, status string!, created_at ts!""",
    "categories": "category_id string!, category_name string!, description string!, created_at ts!",
    "equipments": """equipment_id id!, equipment_name string!, equipment_type string!,
        status string!, description string, equipment_value money!, purchase_price money!,
        rental_price_per_day money!, depreciation_rate rate!, total_usage_days int!,
        purchase_date ts!, brand string, model string, mount_type string, category_id string,
        is_high_value int, deposit_rate rate, created_at ts!""",
    "rentals": """rental_id id!, rental_code string!, rental_type string!, status string!,
        payment_status string, notes string, total_amount money!, deposit_required money!,
        rental_date ts!, start_date ts, due_date ts!, return_date ts, created_at ts!,
        updated_at ts!, customer_id id!, employee_id id!, shop_id id!, customer_name string,
        customer_phone string, customer_address string, customer_confirmed int, confirmed_at ts,
        contract_terms string""",
    "rental_items": """rental_item_id id!, rental_id id!, equipment_id id!, quantity int!,
        days int!, price_per_day money!, subtotal money!, item_status string!""",
    "rental_item_media": """media_id id!, rental_item_id id!, media_type string,
        media_path string!, capture_stage string!, created_at ts!""",
    "returns": """return_id id!, return_date ts!, condition_status string!, damage_percent rate,
        damage_fee money, late_fee money, notes string, inspection_status string, checked_by id,
        checked_at ts, rental_item_id id!""",
    "taxes": """tax_id string!, tax_name string!, description string!, tax_rate rate!,
        is_active int!, effective_from ts!, effective_to ts!, created_at ts!, updated_at ts!""",
    "invoices": """invoice_id id!, invoice_number string!, status string!, notes string,
        rental_amount money!, late_fee money, damage_fee money, shipping_fee money,
        subtotal_amount money!, tax_amount money!, total_amount money!, deposit_used money,
        final_amount money!, invoice_date ts!, payment_due_date ts!, created_at ts!,
        invoice_type string, tax_id string!, rental_id id!""",
    "payments": """payment_id id!, payment_method string!, payment_type string!,
        payment_status string!, transaction_code string, amount money!, payment_date ts!,
        created_at ts!, notes string, invoice_id id, rental_id id""",
    "deposits": """deposit_id id!, deposit_amount money!, refund_amount money,
        extra_charge_amount money, status string!, deposit_date ts!, refund_date ts,
        created_at ts, rental_id id!, payment_id id!""",
    "shipments": """shipment_id id!, shipping_address string, shipping_method string!,
        shipment_type string!, shipping_status string!, shipping_fee money, shipped_date ts,
        delivered_date ts, created_at ts!, rental_id id!""",
    "inventory": """inventory_id id!, total_quantity int!, available_quantity int!,
        rented_quantity int, maintenance_quantity int, damaged_quantity int, lost_quantity int,
        last_updated ts, equipment_id id!""",
    "equipment_images": """image_id id!, image_url string!, is_primary int!, created_at ts!,
        equipment_id id!""",
    "equipment_accessories": """equipment_id id!, accessory_id id!, quantity int!,
        created_at ts!""",
    "system_log": """log_id id!, action string!, table_name string!, record_id string,
        action_time ts!, description string, ip_address string""",
}

_TYPES = {
    "ts": "timestamp_ntz", "money": "decimal(10,2)", "rate": "decimal(5,2)",
    "coord": "decimal(9,6)",
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    name: (columns.split()[0],) for name, columns in TABLES.items()
} | {"equipment_accessories": ("equipment_id", "accessory_id")}

UNIQUE: tuple[tuple[str, str], ...] = (
    ("customers", "username"), ("customers", "email"),
    ("employees", "username"), ("employees", "email"),
    ("rentals", "rental_code"), ("invoices", "invoice_number"),
    ("payments", "transaction_code"), ("deposits", "rental_id"),
    ("inventory", "equipment_id"),
)

# (table, column, parent table, parent column)
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("equipments", "category_id", "categories", "category_id"),
    ("rentals", "customer_id", "customers", "customer_id"),
    ("rentals", "employee_id", "employees", "employee_id"),
    ("rentals", "shop_id", "shop_info", "shop_id"),
    ("rental_items", "rental_id", "rentals", "rental_id"),
    ("rental_items", "equipment_id", "equipments", "equipment_id"),
    ("rental_item_media", "rental_item_id", "rental_items", "rental_item_id"),
    ("returns", "rental_item_id", "rental_items", "rental_item_id"),
    ("returns", "checked_by", "employees", "employee_id"),
    ("invoices", "tax_id", "taxes", "tax_id"),
    ("invoices", "rental_id", "rentals", "rental_id"),
    ("payments", "invoice_id", "invoices", "invoice_id"),
    ("payments", "rental_id", "rentals", "rental_id"),
    ("deposits", "rental_id", "rentals", "rental_id"),
    ("deposits", "payment_id", "payments", "payment_id"),
    ("shipments", "rental_id", "rentals", "rental_id"),
    ("inventory", "equipment_id", "equipments", "equipment_id"),
    ("equipment_images", "equipment_id", "equipments", "equipment_id"),
    ("equipment_accessories", "equipment_id", "equipments", "equipment_id"),
    ("equipment_accessories", "accessory_id", "equipments", "equipment_id"),
)

ENUMS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("customers", "status", ("ACTIVE", "INACTIVE")),
    ("employees", "status", ("ACTIVE", "INACTIVE")),
    ("equipments", "equipment_type", ("MAIN", "ACCESSORY")),
    ("equipments", "status", ("AVAILABLE", "MAINTENANCE", "DISABLED")),
    ("rentals", "status",
     ("CREATED", "CONFIRMED", "BORROWING", "RETURNED", "OVERDUE", "CANCELLED")),
    ("rentals", "payment_status", ("UNPAID", "PARTIAL", "PAID")),
    ("rental_items", "item_status", ("BORROWING", "RETURNED", "DAMAGED", "LOST")),
    ("rental_item_media", "media_type", ("IMAGE", "VIDEO")),
    ("rental_item_media", "capture_stage", ("BEFORE_DELIVERY", "AFTER_RETURN")),
    ("returns", "condition_status", ("GOOD", "DAMAGED", "BROKEN", "LOST")),
    ("returns", "inspection_status", ("PENDING", "CHECKED", "CONFIRMED")),
    ("invoices", "status", ("PENDING", "PAID", "PARTIAL", "CANCELLED")),
    ("invoices", "invoice_type", ("FINAL", "ADJUSTMENT")),
    ("payments", "payment_method", ("CASH", "CARD", "BANK_TRANSFER", "E_WALLET")),
    ("payments", "payment_type", ("DEPOSIT", "RENTAL", "REFUND", "EXTRA")),
    ("payments", "payment_status", ("PENDING", "COMPLETED", "FAILED")),
    ("deposits", "status", ("HELD", "REFUNDED", "PARTIAL_REFUND", "USED", "EXTRA_CHARGED")),
    ("shipments", "shipping_method", ("DELIVERY", "PICKUP")),
    ("shipments", "shipment_type", ("OUTBOUND", "RETURN")),
    ("shipments", "shipping_status", ("PENDING", "SHIPPED", "DELIVERED", "RETURNED", "FAILED")),
)

FLAGS: tuple[tuple[str, str], ...] = (("taxes", "is_active"), ("equipment_images", "is_primary"))

# (table, rule name, column shown, condition that has to hold; NULL passes)
RANGES: tuple[tuple[str, str, str, str], ...] = (
    ("returns", "damage_percent", "damage_percent", "damage_percent BETWEEN 0 AND 100"),
    ("deposits", "deposit_amount", "deposit_amount", "deposit_amount >= 0"),
    ("deposits", "refund_amount", "refund_amount", "refund_amount >= 0"),
    ("deposits", "refund_within_deposit", "refund_amount", "refund_amount <= deposit_amount"),
    ("deposits", "extra_charge_amount", "extra_charge_amount", "extra_charge_amount >= 0"),
    ("inventory", "available_quantity", "available_quantity", "available_quantity >= 0"),
    ("inventory", "rented_quantity", "rented_quantity", "rented_quantity >= 0"),
    ("inventory", "maintenance_quantity", "maintenance_quantity", "maintenance_quantity >= 0"),
    ("inventory", "damaged_quantity", "damaged_quantity", "damaged_quantity >= 0"),
    ("inventory", "lost_quantity", "lost_quantity", "lost_quantity >= 0"),
)

PAYMENT_REFERENCE = """(payment_type = 'DEPOSIT' AND rental_id IS NOT NULL AND invoice_id IS NULL)
    OR (payment_type = 'RENTAL' AND invoice_id IS NOT NULL)
    OR (payment_type = 'REFUND' AND rental_id IS NOT NULL)
    OR (payment_type = 'EXTRA' AND invoice_id IS NOT NULL)"""

BUCKET_SUM = """total_quantity = available_quantity + rented_quantity + maintenance_quantity
    + damaged_quantity + lost_quantity"""

# Values of omitted columns; "now" is the caller's clock.
DEFAULTS: dict[str, dict[str, str]] = {
    "equipments": {"is_high_value": "0", "deposit_rate": "0.2"},
    "rentals": {"customer_confirmed": "0"},
    "returns": {"damage_fee": "0", "late_fee": "0", "inspection_status": "PENDING"},
    "invoices": {"late_fee": "0", "damage_fee": "0", "shipping_fee": "0", "deposit_used": "0"},
    "deposits": {"created_at": "now"},
    "shipments": {"shipping_fee": "0"},
    "inventory": {
        "rented_quantity": "0", "maintenance_quantity": "0", "damaged_quantity": "0",
        "lost_quantity": "0", "last_updated": "now",
    },
}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    required: bool


def columns(table: str, id_type: str = "bigint") -> list[ColumnSpec]:
    """Columns of a table with their Spark types."""
    specs = []
    for part in TABLES[table].split(","):
        name, kind = part.split()
        bare = kind.rstrip("!")
        spark = id_type if bare == "id" else _TYPES.get(bare, bare)
        specs.append(ColumnSpec(name, spark, kind.endswith("!")))
    return specs


def schema(table: str, id_type: str = "bigint") -> StructType:
    """The table as a Spark schema."""
    return StructType.fromDDL(
        ", ".join(
            f"{c.name} {c.type}" + (" NOT NULL" if c.required else "")
            for c in columns(table, id_type)
        )
    )
