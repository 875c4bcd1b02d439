"""The engine's queries over the sample tables; importing the modules registers them."""

from panelspark.plans import artifacts, decisions, ledger, market, masters, more, pit, strategies, study
from panelspark.plans.tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "artifacts", "decisions", "ledger", "market", "masters", "more", "pit", "strategies", "study"]
