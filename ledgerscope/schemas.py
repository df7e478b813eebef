"""Table schemas, vocabularies and constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The zero address and the addresses that count as burned, in lower case.
ZERO = "0x" + "0" * 40
DEAD = "0x" + "0" * 36 + "dead"
BURN = (ZERO, DEAD)

#: Which kinds of transfer a mode counts.
MODES = {"all": ("mint", "burn", "secondary", "unclassified"), "secondary_only": ("secondary",), "primary_only": ("mint", "burn")}
KINDS = MODES["all"]
CATEGORIES = ("creation", "destruction", "issuer_linked", "residual", "unresolved")
DENOMINATIONS = {"native": ("amount", "total_supply"), "usd": ("amount_usd", "market_value_usd")}

SHARE_CEILING = 1 + 1e-9
SNAPSHOT_GRACE_HOURS = 1
HOLDER_LIST_FLOOR = 0.99
RETAINED_COVERAGE_FLOOR = 0.5
HHI_SCALE = 10_000
TOP_N = 10
DISAGREEMENT_TOLERANCE = 0.01
STALE_DAYS = 1
MATERIAL_CHANGE = 0.10

_S, _D, _TS, _I, _L = T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType(), T.LongType()


@dataclass(frozen=True)
class Table:
    """A declared table: its schema (nullability included), key, and the checks of its columns as SQL that must not be false."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    checks: tuple[tuple[str, str, str], ...]  # column, name of the check, condition


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_ENVELOPE = (("asset_uid", _S, False), ("source", _S, False), ("retrieved_at", _TS, False))
_UID = ("asset_uid", "pattern", r"asset_uid rlike '^[^:\\s]+:[^:\\s]+$'")
_SOURCE = ("source", "length", "length(source) >= 1")


def _at_least_zero(*names: str) -> tuple[tuple[str, str, str], ...]:
    return tuple((n, "not negative", f"{n} >= 0") for n in names)


SNAPSHOTS = Table(
    "asset_snapshots",
    _struct(
        *_ENVELOPE, ("as_of", _TS, False), ("symbol", _S, True), ("name", _S, True), ("decimals", _I, True), ("total_supply", _D, True),
        ("market_value_usd", _D, True), ("price_usd", _D, True), ("holder_count", _L, True),
    ),
    ("asset_uid", "source", "as_of"),
    (_UID, _SOURCE, ("decimals", "range", "decimals between 0 and 36"), *_at_least_zero("total_supply", "market_value_usd", "price_usd", "holder_count")),
)
TRANSFERS = Table(
    "transfer_events",
    _struct(
        *_ENVELOPE, ("block_time", _TS, False), ("tx_hash", _S, False), ("log_index", _L, False), ("from_address", _S, False),
        ("to_address", _S, False), ("amount", _D, False), ("amount_usd", _D, True), ("kind", _S, False),
    ),
    ("asset_uid", "source", "tx_hash", "log_index"),
    (
        _UID, _SOURCE, ("tx_hash", "length", "length(tx_hash) >= 1"), ("from_address", "length", "length(from_address) >= 1"),
        ("to_address", "length", "length(to_address) >= 1"), ("kind", "membership", "kind in ('mint', 'burn', 'secondary', 'unclassified')"),
        *_at_least_zero("log_index", "amount", "amount_usd"),
    ),
)
HOLDERS = Table(
    "holder_balances",
    _struct(*_ENVELOPE, ("as_of", _TS, False), ("address", _S, False), ("balance", _D, False), ("balance_usd", _D, True)),
    ("asset_uid", "source", "as_of", "address"),
    (_UID, _SOURCE, ("address", "length", "length(address) >= 1"), *_at_least_zero("balance", "balance_usd")),
)
