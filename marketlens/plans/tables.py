"""The six input tables as one lazily built bundle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Builder = Callable[[], DataFrame]


class Tables:
    """Six tables plus the date every operator treats as "today".

    Each table is given as a DataFrame or as a function that builds one, so a query
    only pays (in analysis time, too) for the tables it names. Two views exist next
    to the six so that a source which has to *derive* ``is_first_deposit`` is not
    made to do so by queries that never look at it:

    * ``ledger`` - transactions without the first-deposit flag
    * ``first_deposits`` - customer_id, transaction_date, amount of flagged rows
    """

    NAMES = (
        "customers", "transactions", "betting_activity", "sessions", "campaigns",
        "customer_campaigns",
    )

    def __init__(self, as_of: dt.date, **sources: DataFrame | Builder):
        self.as_of = as_of
        self._sources = sources
        self._built: dict[str, DataFrame] = {}

    def _table(self, name: str, default: Builder | None = None) -> DataFrame:
        if name not in self._built:
            source = self._sources.get(name, default)
            if source is None:
                raise KeyError(f"table {name!r} was not supplied")
            self._built[name] = source if isinstance(source, DataFrame) else source()
        return self._built[name]

    @property
    def customers(self) -> DataFrame:
        return self._table("customers")

    @property
    def transactions(self) -> DataFrame:
        return self._table("transactions")

    @property
    def betting_activity(self) -> DataFrame:
        return self._table("betting_activity")

    @property
    def sessions(self) -> DataFrame:
        return self._table("sessions")

    @property
    def campaigns(self) -> DataFrame:
        return self._table("campaigns")

    @property
    def customer_campaigns(self) -> DataFrame:
        return self._table("customer_campaigns")

    @property
    def ledger(self) -> DataFrame:
        return self._table("ledger", lambda: self.transactions.drop("is_first_deposit"))

    @property
    def first_deposits(self) -> DataFrame:
        return self._table(
            "first_deposits",
            lambda: self.transactions.where("is_first_deposit").select(
                "customer_id", "transaction_date", "amount"
            ),
        )

    @property
    def today(self) -> Column:
        return F.lit(self.as_of)

    @property
    def midnight(self) -> Column:
        """``as_of`` at 00:00 as a zone-free timestamp."""
        return F.lit(self.as_of).cast("timestamp_ntz")

    def replace(self, as_of: dt.date | None = None, **sources: DataFrame | Builder) -> Tables:
        """A bundle with some tables swapped; the derived views follow the swap."""
        kept = dict(self._sources)
        if "transactions" in sources:
            kept.pop("ledger", None)
            kept.pop("first_deposits", None)
        return Tables(as_of or self.as_of, **{**kept, **sources})

    def register_views(self, prefix: str = "") -> None:
        """Make the six tables available to ``spark.sql``."""
        for name in self.NAMES:
            self._table(name).createOrReplaceTempView(prefix + name)
